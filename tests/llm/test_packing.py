import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sphaera.llm import packing

JSON = P.path("byte_bpe_50k.json")


def encoded(texts):
    return [np.array([*x.ids, 0], "<u4") for x in Tokenizer.from_file(JSON).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_cut():
    for start, n, length in ((0, 0, 8), (0, 8, 8), (3, 5, 8), (3, 6, 8), (7, 30, 8), (16, 1, 8)):
        begins, sizes = packing.cut(start, n, length)
        assert sizes.sum() == n and all(s > 0 for s in sizes) and np.array_equal(np.cumsum(sizes) - sizes, begins)
        assert all((start + b) // length == (start + b + s - 1) // length for b, s in zip(begins, sizes, strict=True))
        assert all((start + b) % length == 0 for b in begins[1:])


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_pieces_equal_the_library(spark, request, name):
    docs = request.getfixturevalue(name).repartition(7)
    rows = docs.select("doc_id", "text").collect()
    out = packing.pack(docs, JSON, P.PATTERN, 0).collect()
    held = {}
    for r in out:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, spans in held.items():  # gapless from 0, full but for the last sequence
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert sum(n for _, n in spans) == 1024 or k == max(held)
    assert sorted(held) == list(range(len(held)))
    want = {}
    for r, ids in zip(rows, encoded([r["text"] for r in rows]), strict=True):
        want.setdefault((r["doc_id"], len(ids)), []).append(ids)
    got = {}
    for r in out:
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert got.keys() == want.keys()
    for key, pieces in got.items():
        copies = want[key]
        assert sum(p["length"] for p in pieces) == sum(map(len, copies))
        for p in pieces:
            assert any(zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in copies)


def test_sequences_hold_every_id(spark, docs):
    some = docs.repartition(5)
    out = packing.sequences(some, JSON, P.PATTERN, 0, pad_id=1, length=64).orderBy("sequence_id").collect()
    assert [r["sequence_id"] for r in out] == list(range(len(out)))
    assert all(len(r["ids"]) == 64 for r in out[:-1]) and all(r["used"] == 64 for r in out[:-1])
    last = out[-1]
    assert len(last["ids"]) == 64 or len(last["ids"]) & (len(last["ids"]) - 1) == 0
    assert all(x == 1 for x in last["ids"][last["used"] :])
    assert sum(r["used"] for r in out) == sum(map(len, encoded([r["text"] for r in docs.collect()])))
    rows = docs.collect()
    text = {r["doc_id"]: ids.tolist() for r, ids in zip(rows, encoded([r["text"] for r in rows]), strict=True)}
    flow = [x for r in out for x in r["ids"][: r["used"]]]
    begins = [(64 * r["sequence_id"] + s, d) for r in out for s, d in zip(r["starts"], r["doc_ids"], strict=True)]
    firsts = {}
    for at, d in begins:
        firsts.setdefault(d, at)
    assert all(flow[at : at + len(text[d])] == text[d] for d, at in firsts.items())


def test_places_follow_the_partitions(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 9)) for i in range(50)], "doc_id long, text string").repartition(6)
    w = packing.write_ids(docs, JSON, P.PATTERN, 0)
    rows = sorted((r["at"], r["n"]) for r in packing.placed(w).collect())
    assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False))
