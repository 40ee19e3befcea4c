"""Token ids in files of patched frame-of-reference blocks.

Documents are sorted by id over range partitions; every partition becomes one file of the shared folder:

    magic | n_docs | n_null_ids | n_ids | section(id steps) | section(ids per document) | section(ids)

A section holds non-negative integers in blocks of 1024.  A block subtracts its minimum and packs the rest at the width
that the PERCENTILE-th part of its values needs; the few larger values are patched: their low bits stay in the packed
block, their positions and full values go to an exception list.  An index of block starts makes every block readable
alone.  A manifest (one row per file, in order) makes the files one sequence; a file counts only once it is in the
manifest, so a lost executor or a second attempt leaves at most an unlisted file.

The tokenizer's added tokens are taken out of a text before it is split, as the tokenizers library does as loaded
(add_special_tokens=False governs only what is put around a text).  With plain_text=True their strings are ordinary text,
the library's encode_special_tokens, so that no text can forge a control id.

Null texts are empty: such a document is its end id alone.  Null ids sort first.  Rows of equal id are kept in the order
of their texts.  An empty table gives no files and no rows.  A text of any length is encoded whole, in memory.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.llm.common import doc_texts, materialise, new_folder, open_uri, spread

BLOCK = 1024
PERCENTILE = 0.9
MAGIC = b"SPHPFOR1"
CACHED_PIECES = 400_000


def _container(width: int) -> int:
    """Bytes of the smallest integer that holds width bits."""
    return next(k for k in (1, 2, 4, 8) if width <= 8 * k)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """rows (blocks x BLOCK) of values below 2**width as (blocks x BLOCK * width / 8) bytes, high bits first."""
    if width == 0:
        return np.zeros((len(rows), 0), np.uint8)
    size = _container(width)
    raw = np.ascontiguousarray(rows.astype(f">u{size}")).view(np.uint8).reshape(len(rows), -1)
    if width == 8 * size:
        return raw
    bits = np.unpackbits(raw, axis=1).reshape(len(rows), BLOCK, 8 * size)[:, :, 8 * size - width :]
    return np.packbits(bits.reshape(len(rows), -1), axis=1)


def _unpack(raw: np.ndarray, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros((len(raw), BLOCK), np.uint64)
    size = _container(width)
    if width < 8 * size:
        bits = np.zeros((len(raw), BLOCK, 8 * size), np.uint8)
        bits[:, :, 8 * size - width :] = np.unpackbits(raw, axis=1).reshape(len(raw), BLOCK, width)
        raw = np.packbits(bits.reshape(len(raw), -1), axis=1)
    return np.ascontiguousarray(raw).view(f">u{size}").astype(np.uint64)


def _bit_length(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape, np.int64)
    for k in range(64):
        out[x >= np.uint64(1 << k)] = k + 1
    return out


#: Blocks that are packed at once; bounds the working memory of a section of any length.
SLICE = 512


def _encode_blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minima, widths, patches per block, patch places, patch values, packed bytes) of up to SLICE blocks."""
    n = len(values)
    blocks = -(-n // BLOCK)
    rows = np.zeros(blocks * BLOCK, np.uint64)
    rows[:n] = values
    rows = rows.reshape(blocks, BLOCK)
    if n % BLOCK:
        rows[-1, n % BLOCK :] = rows[-1, 0]
    low = rows.min(1)
    rest = rows - low[:, None]
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = _bit_length(np.partition(rest, rank, axis=1)[:, rank])
    limit = np.where(width >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(width, 63).astype(np.uint64)) - np.uint64(1))
    odd = rest > limit[:, None]
    block_of, place = np.nonzero(odd)
    start = np.concatenate([[0], np.cumsum(BLOCK // 8 * width)])
    body = np.zeros(int(start[-1]), np.uint8)
    masked = rest & limit[:, None]
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for k, row in zip(at, _pack(masked[at], int(w)), strict=True):
            body[int(start[k]) : int(start[k + 1])] = row
    return low, width, np.bincount(block_of, minlength=blocks), place, rest[odd], body


def encode_section(values: np.ndarray) -> bytes:
    parts = [_encode_blocks(values[k : k + SLICE * BLOCK]) for k in range(0, len(values), SLICE * BLOCK)]
    low, width, patches, place, value, body = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(6))
    start = np.concatenate([[0], np.cumsum(BLOCK // 8 * width)])
    size = next(k for k in (1, 2, 4, 8) if not len(value) or k == 8 or int(value.max()) < 1 << (8 * k))  # bytes of a patch value
    head = np.array([len(values), len(low), len(place), size], "<u8").tobytes()
    return b"".join([head, start.astype("<u8").tobytes(), low.astype("<u8").tobytes(), width.astype("u1").tobytes(), patches.astype("<u2").tobytes(), place.astype("<u2").tobytes(), value.astype(f"<u{size}").tobytes(), body.astype("u1").tobytes()])


class Section:
    """A section of a file that is read block by block or whole."""

    def __init__(self, raw: memoryview, at: int):
        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype, n, at)
            at += out.nbytes
            return out

        self.n, self.blocks, odd, size = (int(x) for x in take("<u8", 4))
        self.start, self.low = take("<u8", self.blocks + 1).astype(np.int64), take("<u8", self.blocks)
        self.width, patches = take("u1", self.blocks).astype(int), take("<u2", self.blocks).astype(np.int64)
        self.patch_start = np.concatenate([[0], np.cumsum(patches)])
        self.place, self.value = take("<u2", odd), take(f"<u{size}", odd).astype(np.uint64)
        self.body = take("u1", int(self.start[-1]))
        self.end = at

    def read_blocks(self, lo: int, hi: int) -> np.ndarray:
        if hi - lo > SLICE:
            return np.concatenate([self.read_blocks(k, min(hi, k + SLICE)) for k in range(lo, hi, SLICE)])
        out = np.zeros((hi - lo, BLOCK), np.uint64)
        width = self.width[lo:hi]
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            raw = np.stack([self.body[self.start[lo + k] : self.start[lo + k + 1]] for k in at])
            out[at] = _unpack(raw, int(w))
        a, b = self.patch_start[lo], self.patch_start[hi]
        of = np.repeat(np.arange(hi - lo), np.diff(self.patch_start[lo : hi + 1]))
        out[of, self.place[a:b]] = self.value[a:b]
        out += self.low[lo:hi, None]
        return out.reshape(-1)[: min(self.n, hi * BLOCK) - lo * BLOCK]

    def read(self) -> np.ndarray:
        return self.read_blocks(0, self.blocks) if self.blocks else np.zeros(0, np.uint64)


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    zigzag = np.zeros(0, np.uint64)
    if len(known):
        steps = np.diff(known, prepend=np.int64(0))
        zigzag = ((steps << 1) ^ (steps >> 63)).view(np.uint64)
    head = np.array([len(doc_ids), len(doc_ids) - len(known), len(ids)], "<u8").tobytes()
    return MAGIC + head + encode_section(zigzag) + encode_section(lengths) + encode_section(ids)


def decode_file(raw: bytes) -> tuple[list[int | None], np.ndarray, Section]:
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_null, _ = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
    view = memoryview(raw)
    steps = Section(view, 32)
    lengths = Section(view, steps.end)
    ids = Section(view, lengths.end)
    z = steps.read()
    back = (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)
    doc_ids = [None] * n_null + np.cumsum(back).tolist()
    if len(doc_ids) != n_docs:
        raise ValueError("token file is cut off")
    return doc_ids, lengths.read().astype(np.int64), ids


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: 0 the space, 1 other white space, 2 letters, 3 numbers, 4 all else."""
    out = np.full(0x110000, 4, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    back = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    for k, pattern in ((1, r"\s+"), (2, r"\p{L}+"), (3, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[back[m.start() : m.end()]] = k
    out[32] = 0
    return out


#: The pattern that PieceEncoder's rules below stand for.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def split_run(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts in one string, first and last + 1 character and text number of every match, code points).

    The matches of SPLIT_PATTERN follow from runs of one class: a single space goes with the run after it; of longer white
    space before a word the last character stands alone (or goes with the word, if it is a space); white space that ends
    the text is one match; an apostrophe that starts a match takes a following s, t, m, d, re, ve or ll.
    """
    big = "\n".join([*texts, ""])
    cps = np.frombuffer(big.encode("utf-32-le"), "<u4")
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    mark = np.cumsum(size) - 1  # the line feed after each text is no part of it
    kind = _classes()[cps]
    kind[mark] = 9
    space = kind <= 1
    run = np.where(space, 1, kind)
    begins = np.append(True, run[1:] != run[:-1])
    begins[mark] = True
    begins[mark[:-1] + 1] = True
    at = np.flatnonzero(begins)
    stop = np.append(at[1:], len(cps))
    gap = np.flatnonzero(space[at] & (kind[np.minimum(stop, len(cps) - 1)] != 9))
    last = stop[gap] - 1
    begins[last] = True
    begins[last[cps[last] == 32] + 1] = False
    quote = np.flatnonzero((cps == 39) & begins)
    one, two = cps[np.minimum(quote + 1, len(cps) - 1)], cps[np.minimum(quote + 2, len(cps) - 1)]
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    begins[quote[single | double] + 1] = False
    begins[quote[single] + 2] = True
    begins[quote[double] + 3] = True
    at = np.flatnonzero(begins)
    stop = np.append(at[1:], len(cps))
    real = kind[at] != 9
    at, stop = at[real], stop[real]
    return big, at, stop, np.searchsorted(mark, at), cps


class PieceEncoder:
    """The tokenizers library's model over the pieces of texts, each distinct piece of a run of texts looked up once.

    A run of texts is split in numpy and equal pieces are found by hash (two hashes of 64 bits, the second as a check).
    The model, its byte alphabet applied first, tokenizes the pieces that no earlier run had.
    """

    def __init__(self, path: str, pattern: str, plain_text: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        if pattern != SPLIT_PATTERN:
            raise ValueError("the split rules stand for another pattern")
        library = Tokenizer.from_file(path)
        self.model = library.model
        added = {} if plain_text else library.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("an added token takes in what stands around it")
        self.added = {t.content: np.array([i], "<u4") for i, t in added.items()}
        # the longest token counts where several start
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letter = {b: alphabet.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        # the alphabet of the other bytes follows from characters that hold them
        for lead in range(0xC2, 0xF5):
            tail = [0x90 if lead == 0xF0 else 0xA0 if lead == 0xE0 else 0x80] + [0x80] * (0 if lead < 0xE0 else 1 if lead < 0xF0 else 2)
            self._learn(alphabet, bytes([lead, *tail]))
        for tail in range(0x80, 0xC0):
            self._learn(alphabet, bytes([0xC2, tail]))
        # two generations: what has been used since the last turn survives the next one
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def _learn(self, alphabet, raw: bytes) -> None:
        for b, c in zip(raw, alphabet.pre_tokenize_str(raw.decode())[0][0], strict=True):
            self.letter[b] = c

    def _new(self, piece: str) -> bytes:
        known = self.old_pieces.get(piece)
        if known is None:
            if piece.isascii() and piece[1:].isalpha() and piece[0] == " ":
                mapped = self.letter[32] + piece[1:]
            else:
                mapped = piece.encode().decode("latin-1").translate(self.letter)
            known = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(piece) <= 64:
            if len(self.pieces) > CACHED_PIECES:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = known
        return known

    def encode(self, text: str) -> np.ndarray:
        return self.encode_run([text])[0]

    def encode_run(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text.  texts: about RUN_BYTES together, or a single longer one."""
        if not any(t in x for t in self.added for x in texts):
            return self._encode_parts(texts)
        cut = [self.marks.split(x) for x in texts]  # every second part is an added token
        ids = iter(self._encode_parts([p for parts in cut for p in parts[::2]]))
        return [np.concatenate([self.added[p] if k % 2 else next(ids) for k, p in enumerate(parts)]) for parts in cut]

    def _encode_parts(self, texts: list[str]) -> list[np.ndarray]:
        big, at, stop, owner, cps = split_run(texts)
        if not len(at):
            return [np.zeros(0, "<u4") for _ in texts]
        length = stop - at
        # pieces lie apart only by the marks between texts, whose places count for nothing
        place = np.arange(len(cps)) - np.repeat(at, np.append(at[1:], len(cps)) - at) if at[0] == 0 else None
        if place is None:
            place = np.arange(len(cps) - at[0]) - np.repeat(at - at[0], np.append(at[1:], len(cps)) - at)
        value = cps[at[0] :].astype(np.uint64) + np.uint64(1)
        inside = place < np.repeat(length, np.append(at[1:], len(cps)) - at)
        value[~inside] = 0
        longest = int(place.max()) + 1
        with np.errstate(over="ignore"):
            name = [np.add.reduceat(value * _step(k, longest)[place], at - at[0]) for k in (0, 1)]
        _, rep, of = np.unique(name[0], return_index=True, return_inverse=True)
        if not (np.array_equal(name[1][rep][of], name[1]) and np.array_equal(length[rep][of], length)):
            rep, of = np.arange(len(at)), np.arange(len(at))
        get = self.pieces.get
        words = [big[i:j] for i, j in zip(at[rep].tolist(), stop[rep].tolist(), strict=True)]
        ids = [get(w) or self._new(w) for w in words]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = np.frombuffer(b"".join(ids), "<u4")
        each = n[of]
        total = np.cumsum(each)
        out = table[np.repeat((np.cumsum(n) - n)[of] - (total - each), each) + np.arange(int(total[-1]))]
        ends = np.cumsum(np.bincount(owner, each, len(texts)).astype(np.int64))
        return np.split(out, ends[:-1])


RUN_BYTES = 1 << 20
_STEPS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _step(k: int, n: int) -> np.ndarray:
    """Powers of an odd number, one for each place in a piece; of a number of its own for each of the two hashes."""
    if len(_STEPS[k]) < n:
        base = np.full(max(n, 1024), np.uint64((0xD1342543DE82EF95, 0x9FB21C651E98DF25)[k]))
        base[0] = 1
        with np.errstate(over="ignore"):
            _STEPS[k] = np.cumprod(base)
    return _STEPS[k]


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str, plain_text: bool) -> PieceEncoder:
    return PieceEncoder(path, pattern, plain_text)


def _runs(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= RUN_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def write_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int | None, name: str = "tokens", plain_text: bool = False) -> DataFrame:
    """Encode every text, write the files in ascending id order, return the manifest: file_no, path, n_docs, n_ids.

    A manifest row is as small as its path, so the manifest has a few bytes per file, whatever the files hold.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, doc_ids, lengths, parts = _encoder(tokenizer_path, pattern, plain_text), [], [], []
        end = np.array([] if end_id is None else [end_id], "<u4")
        for b in batches:
            doc_ids += b.column(0).to_pylist()
            for texts in _runs(b.column(1).to_pylist()):
                for ids in encoder.encode_run(texts):
                    parts += [ids.tobytes(), end.tobytes()]
                    lengths.append(len(ids) + len(end))
        if not doc_ids:
            return
        no = TaskContext.get().partitionId()
        fs, root = open_uri(folder)
        fs.create_dir(root, recursive=True)
        path = f"part-{no:06d}-{uuid.uuid4().hex}.pfor"
        with fs.open_output_stream(f"{root}/{path}.open") as out:
            out.write(encode_file(doc_ids, np.array(lengths, np.int64), np.frombuffer(b"".join(parts), "<u4")))
        fs.move(f"{root}/{path}.open", f"{root}/{path}")
        yield pa.RecordBatch.from_pylist([{"file_no": no, "path": f"{folder}/{path}", "n_docs": len(doc_ids), "n_ids": int(sum(lengths))}], pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = doc_texts(docs).repartitionByRange(spread(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(run, "file_no long, path string, n_docs long, n_ids long"), f"{name}-manifest")


def read_tokens(manifest: DataFrame, digests: bool = False) -> DataFrame:
    """From the files alone: doc_id, start (ids of all documents before), n_tokens and ids, or ids_crc32 with digests."""
    spark = manifest.sparkSession
    at, rows = 0, []
    for r in manifest.orderBy("file_no").collect():
        rows.append((r["path"], at))
        at += r["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, inner = open_uri(path)
                with fs.open_input_file(inner) as f:
                    doc_ids, lengths, section = decode_file(f.read())
                ids = np.concatenate([section.read_blocks(k, min(section.blocks, k + SLICE)).astype("<u4") for k in range(0, section.blocks, SLICE)] or [np.zeros(0, "<u4")])
                stop = np.cumsum(lengths)
                start = stop - lengths
                for lo in range(0, len(doc_ids), 5000):
                    part = range(lo, min(lo + 5000, len(doc_ids)))
                    own = [ids[start[i] : stop[i]] for i in part]
                    last = pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()) if digests else pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([doc_ids[i] for i in part], pa.int64()), pa.array(base + start[lo : lo + 5000]), pa.array(lengths[lo : lo + 5000]), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<long>"))


def round_trip(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int) -> DataFrame:
    return read_tokens(write_tokens(docs, tokenizer_path, pattern, end_id), digests=True).select("doc_id", "start", "n_tokens", F.col("ids_crc32"))
