import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from sphaera.llm import bpe, pfor

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_equals_library():
    codec, lib = bpe.TreeBpe(bpe.load_ranks(RANKS), P.PATTERN), reference()
    random.seed(1)
    for trial in range(150):
        n = 20_000 if trial % 50 == 0 else random.choice([0, 1, 7, 60, 400])
        alphabet = random.choice(["ab", "a", "aé ß", "the of and ", "'re 's\n\t x", "😀漢 字", "0123 ", "  \n", "abcdefghijklmnopqrstuvwxyz"])
        t = "".join(random.choice(alphabet) for _ in range(n))
        ids = codec.encode(t)
        assert ids == lib.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_small_leaves_and_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_BYTES", 3)
    monkeypatch.setattr(bpe, "LEAF_CHARS", 5)
    codec, lib = bpe.TreeBpe(bpe.load_ranks(RANKS), P.PATTERN), reference()
    random.seed(2)
    for _ in range(200):
        t = "".join(random.choice("the 'reab \n12é") for _ in range(random.randint(0, 80)))
        assert codec.encode(t) == lib.encode_ordinary(t)


def test_every_token_is_its_own_encoding():
    codec = bpe.TreeBpe(bpe.load_ranks(RANKS), P.PATTERN)
    assert all(codec.merge(t) == [t] for t in codec.ranks)


def test_query_rows(spark, docs, odd, empty):
    lib = reference()
    for table in (docs, odd, empty):
        out = bpe.encode_decode(table, RANKS, P.PATTERN, ("n_tokens", "ids", "ids_sha256", "decoded_sha256")).collect()
        texts = [r["text"] or "" for r in table.collect()]
        assert len(out) == len(texts)
        expected = sorted((len(i := lib.encode_ordinary(t)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
        assert expected == sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out)


def test_sections_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1023, 1024, 1025, 5000):
        for high in (1, 2, 200, 50257, 2**40):
            x = rng.integers(0, high, n).astype(np.uint64)
            if n > 3:
                x[2] = 2**63
            s = pfor.Section(memoryview(pfor.encode_section(x)), 0)
            assert np.array_equal(s.read(), x)
            if n > 2000:
                assert np.array_equal(s.read_blocks(1, 2), x[1024:2048])


def test_files_round_trip(spark, docs, odd, empty):
    lib = Tokenizer.from_file(JSON)
    for table in (docs, odd, empty):
        out = [tuple(r) for r in pfor.round_trip(table, JSON, P.PATTERN, 2).collect()]
        rows = sorted(((r["doc_id"], r["text"] or "") for r in table.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        expected, at = [], 0
        for i, t in rows:
            ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
            expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        key = lambda r: r[1]
        assert sorted(out, key=key) == sorted(expected, key=key)


def test_pieces_equal_whole_texts():
    lib, ours = Tokenizer.from_file(JSON), pfor.PieceEncoder(JSON, P.PATTERN)
    random.seed(2)
    for _ in range(1500):
        t = "".join(random.choice("ab  \n\t'sé .1 ß漢😀\x00") for _ in range(random.randint(0, 40)))
        assert lib.encode(t, add_special_tokens=False).ids == ours.encode(t).tolist(), repr(t)
    run = ["", "a b", "", " \n", "it's", ""]
    assert [x.tolist() for x in ours.encode_run(run)] == [lib.encode(t, add_special_tokens=False).ids for t in run]


def test_added_tokens_as_the_library_takes_them():
    end = "<|endoftext|>"
    rng = random.Random(5)
    texts = ["".join(rng.choice([end, end[:6], " ", "a", "  \n", "it's", "|>", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [end, end * 3, f"a  {end}  b", f"a {end} b"]
    for plain in (False, True):
        lib, ours = Tokenizer.from_file(JSON), pfor.PieceEncoder(JSON, P.PATTERN, plain)
        if plain:
            lib.encode_special_tokens = True
        assert [x.tolist() for x in ours.encode_run(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert pfor.PieceEncoder(JSON, P.PATTERN).encode(f"x{end}y").tolist() == [87, 50256, 88]
