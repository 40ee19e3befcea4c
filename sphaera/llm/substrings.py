"""Removal of repeated byte strings: every byte that a WINDOW-byte string covers which also starts earlier goes.

1.  Anchors (see anchors.py) bring equal windows together: they have equal grams at equal offsets.  Rows of the exchange
    are anchors, a fortieth of the bytes; an anchor whose whole context was met before in the same partition is not sent
    at all, so copies and common passages are aggregated before the shuffle.
2.  Sorted by gram and context (a 128-bit hash), an anchor with the same context as an earlier one is a repeat with all
    its windows.  The first ones of grams with several contexts are open: their contexts agree in part.
3.  Open contexts form shards by gram.  Every shard builds a suffix array by Larsson-Sadakane refinement, Kasai's common
    prefixes cut it into groups of equal windows, and all but the earliest of a group are repeats.
4.  A gram with more contexts than a shard takes is dealt to several shards.  These give out the earliest window of each
    of their groups; runs of such windows are merged over shards by binary search in ranges of the window's hash.
5.  Repeats of a document are united and cut out of its bytes.

"Earlier" is a smaller id, or the same document and an earlier start.  Null texts are empty, nothing is removed from
texts below WINDOW bytes.  Null ids come first.  Rows of one id are ordered by their texts' hash; rows of equal id and
text are one document, and each of them gets its result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.llm.anchors import WINDOW, anchors
from sphaera.llm.common import doc_texts, materialise, spread
from sphaera.llm.suffix import Pieces, least_of_equal

SHARD_CONTEXTS = 2_048
#: Contexts of small grams share a shard up to about so many bytes.
SHARD_BYTES = 2_000_000
#: Anchors that a task remembers at once; what it forgets is sent to the exchange like new ones.
REMEMBERED = 2_000_000


def _keyed(docs: DataFrame) -> DataFrame:
    return doc_texts(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")


def _batch(schema: list[tuple[str, pa.DataType]], **cols: np.ndarray | list | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := cols[n], pa.Array) else pa.array(c, t) for n, t in schema], names=[n for n, _ in schema])


_ANCHOR = [("gram", pa.int64()), ("known", pa.bool_()), ("ctx", pa.int64()), ("ctx2", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]
_ANCHOR_SQL = "gram long, known boolean, ctx long, ctx2 long, doc_id long, th long, lo long, hi long"


def _runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins neighbouring [lo, hi] that follow each other without a gap; lo ascending."""
    new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1] + 1)) if len(lo) else np.zeros(0, np.int64)
    return lo[new], hi[np.append(new[1:], len(lo)) - 1] if len(lo) else hi


def find_anchors(keyed: DataFrame) -> DataFrame:
    """Anchors in document order; those whose gram and context the partition has seen come as runs marked known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        last = None
        for b in batches:
            ids, ths, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()
            out: dict[str, list] = {n: [] for n, _ in _ANCHOR}

            def put(gram, known, ctx, ctx2, doc, th, lo, hi, out=out):
                n = len(lo)
                for name, x in zip(out, (gram, np.full(n, known), ctx, ctx2, np.full(n, doc), np.full(n, th), lo, hi), strict=True):
                    out[name].append(x)

            for doc, th, raw in zip(ids, ths, texts, strict=True):
                if (doc, th) == last or len(raw) < WINDOW:
                    continue
                last = (doc, th)
                gram, ctx, ctx2, lo, hi = anchors(np.frombuffer(raw, np.uint8))
                if len(seen) > REMEMBERED:
                    seen.clear()
                name = np.stack([gram ^ (ctx * np.uint64(0x9E3779B97F4A7C15)), ctx2], axis=1).view("V16").ravel().tolist()
                old = np.zeros(len(name), bool)
                for i, k in enumerate(name):
                    if k in seen:
                        old[i] = True
                    else:
                        seen.add(k)
                first = np.iinfo(np.int64).min if doc is None else doc
                if not old.all():
                    put(gram[~old].view(np.int64), False, ctx[~old].view(np.int64), ctx2[~old].view(np.int64), first, th, lo[~old], hi[~old])
                if old.any():
                    a, z = _runs(lo[old], hi[old])
                    put(np.full(len(a), xxhash.xxh3_64_intdigest(raw[:64] + str(doc).encode()) >> 1, np.int64), True, np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), first, th, a, z)
            if out["lo"]:
                yield _batch(_ANCHOR, **{n: np.concatenate(x) for n, x in out.items()})

    return keyed.sortWithinPartitions("doc_id", "th").mapInArrow(run, _ANCHOR_SQL)


_MARK = [("doc_id", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("gram", pa.int64()), ("shard", pa.int32())]
_MARK_SQL = "doc_id long, th long, lo long, hi long, gram long, shard int"


def judge_anchors(found: DataFrame, n: int) -> DataFrame:
    """Marks: repeats (shard null), and open anchors with the shard of their gram (-1: the gram has one shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None  # last row
        held: list[np.ndarray] = []  # open firsts of the gram at hand: doc, th, lo, hi
        gram, passed = None, 0  # passed: firsts of this gram that are out already

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, passed
            rows = np.concatenate(held, axis=1) if held else np.zeros((4, 0), np.int64)
            n = rows.shape[1]
            held = []
            if n and (n > 1 or passed):
                shard = np.full(n, -1) if final and not passed and n <= SHARD_CONTEXTS else (passed + np.arange(n)) // SHARD_CONTEXTS
                yield _batch(_MARK, doc_id=rows[0], th=rows[1], lo=rows[2], hi=rows[3], gram=np.full(n, gram), shard=shard.astype(np.int32))
            passed += n

        for b in batches:
            g, known, ctx, ctx2, doc, th, lo, hi = (b.column(i).to_numpy(zero_copy_only=False) for i in range(8))
            if known.any():
                yield _batch(_MARK, doc_id=doc[known], th=th[known], lo=lo[known], hi=hi[known], gram=pa.nulls(int(known.sum()), pa.int64()), shard=pa.nulls(int(known.sum()), pa.int32()))
                g, ctx, ctx2, doc, th, lo, hi = (x[~known] for x in (g, ctx, ctx2, doc, th, lo, hi))
            if not len(g):
                continue
            before = tail if tail is not None else (g[0] ^ 1, 0, 0, 0, 0, 0)
            new_gram = np.append(g[0] != before[0], g[1:] != g[:-1])
            new_ctx = new_gram | np.append(ctx[0] != before[1], ctx[1:] != ctx[:-1]) | np.append(ctx2[0] != before[5], ctx2[1:] != ctx2[:-1])
            head = np.maximum.accumulate(np.where(new_ctx, np.arange(len(g)), -1))
            fd, ft, fl = ((np.where(head >= 0, x[np.maximum(head, 0)], before[k])) for x, k in ((doc, 2), (th, 3), (lo, 4)))
            again = ~new_ctx & ~((doc == fd) & (th == ft) & (lo == fl))
            if again.any():
                yield _batch(_MARK, doc_id=doc[again], th=th[again], lo=lo[again], hi=hi[again], gram=pa.nulls(int(again.sum()), pa.int64()), shard=pa.nulls(int(again.sum()), pa.int32()))
            tail = (g[-1], ctx[-1], fd[-1], ft[-1], fl[-1], ctx2[-1])
            at = np.flatnonzero(new_ctx)
            rows = np.stack([doc[at], th[at], lo[at], hi[at]])
            bounds = np.flatnonzero(np.append(True, g[at][1:] != g[at][:-1])) if len(at) else np.zeros(0, np.int64)
            ends = np.append(bounds[1:], len(at))
            if len(at):
                if gram is not None and g[at[0]] != gram:
                    yield from flush(True)
                    gram, passed = None, 0
                # grams that begin and end inside this batch
                size = ends - bounds
                whole = np.ones(len(bounds), bool)
                whole[-1] = False
                if gram is not None:
                    whole[0] = False
                pick = np.repeat(whole & (size > 1) & (size <= SHARD_CONTEXTS), size)
                if pick.any():
                    yield _batch(_MARK, doc_id=rows[0][pick], th=rows[1][pick], lo=rows[2][pick], hi=rows[3][pick], gram=g[at][pick], shard=np.full(int(pick.sum()), -1, np.int32))
                for k in np.flatnonzero(~whole | (size > SHARD_CONTEXTS)):
                    own = g[at[bounds[k]]]
                    if own != gram:
                        if gram is not None:
                            yield from flush(True)
                        gram, passed = own, 0
                    held.append(rows[:, bounds[k] : ends[k]])
                    if sum(x.shape[1] for x in held) > SHARD_CONTEXTS:
                        yield from flush(False)
        yield from flush(True)

    return found.repartition(n, "gram").sortWithinPartitions("gram", "known", "ctx", "ctx2", "doc_id", "th", "lo").mapInArrow(run, _MARK_SQL)


def _packed(keyed: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(t) for t in b.column(2).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "th", "packed"])

    return keyed.mapInArrow(pack, "doc_id long, th long, packed binary")


def _order(c: str) -> F.Column:
    return F.coalesce(F.col(c), F.lit(-(2**63)))


_CONTEXT = [("gram", pa.int64()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("ctx", pa.binary())]


def open_contexts(keyed: DataFrame, marks: DataFrame) -> DataFrame:
    """The bytes of all windows of every open anchor."""
    wanted = marks.where("shard IS NOT NULL").groupBy("doc_id", "th").agg(F.collect_list(F.struct("gram", "shard", "lo", "hi")).alias("open")).withColumnRenamed("doc_id", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out: dict[str, list] = {n: [] for n, _ in _CONTEXT}
            for d, th, packed, found in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                raw = z.decompress(packed)
                for x in found:
                    for n, v in zip(out, (x["gram"], x["shard"], d, th, x["lo"], raw[x["lo"] : x["hi"] + WINDOW]), strict=True):
                        out[n].append(v)
            yield _batch(_CONTEXT, **out)

    texts = _packed(keyed).withColumn("doc_id", _order("doc_id")).dropDuplicates(["doc_id", "th"])
    met = wanted.join(texts, (wanted["d"] == texts["doc_id"]) & (wanted["th"] == texts["th"])).select("d", wanted["th"], "packed", "open")
    return met.mapInArrow(run, "gram long, shard int, doc_id long, th long, lo long, ctx binary")


_FOUND = [("doc_id", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())]
_FOUND_SQL = "doc_id long, th long, lo long, hi long, w1 long, w2 long"


def judge_shard(grams: list[int], shards: list[int], docs: np.ndarray, ths: np.ndarray, los: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Repeats among the windows of one shard's contexts, and its earliest windows of grams that have more shards."""
    t = Pieces(texts)
    _, doc_rank = np.unique(np.stack([docs, ths]), axis=1, return_inverse=True)
    doc_rank = doc_rank.ravel()
    where = los[t.piece] + t.offset
    key = doc_rank[t.piece].astype(np.int64) * (int(where.max()) + 1) + where
    at, least = least_of_equal(t, WINDOW, key)
    repeat = key[at] != least
    rows = at[repeat]
    rows.sort()
    p, s = t.piece[rows], where[rows]
    if len(rows):
        new = np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1))
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(rows)) - 1
        yield _batch(_FOUND, doc_id=docs[p[a]], th=ths[p[a]], lo=s[a], hi=s[z], w1=pa.nulls(len(a), pa.int64()), w2=pa.nulls(len(a), pa.int64()))
    cut = np.array(shards)[t.piece[at]] >= 0
    lead = np.unique(at[cut & ~repeat])
    for k in range(0, len(lead), 50_000):
        part = lead[k : k + 50_000]
        digests = [xxhash.xxh3_128_digest(texts[i][o : o + WINDOW]) for i, o in zip(t.piece[part].tolist(), t.offset[part].tolist(), strict=True)]
        w = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield _batch(_FOUND, doc_id=docs[t.piece[part]], th=ths[t.piece[part]], lo=where[part], hi=where[part], w1=w[:, 0], w2=w[:, 1])


def judge_contexts(contexts: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            g, s, d, h, lo, t = zip(*held, strict=True)
            yield from judge_shard(list(g), list(s), np.array(d, np.int64), np.array(h, np.int64), np.array(lo, np.int64), list(t))

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if held and row[:2] != held[-1][:2] and size > SHARD_BYTES:
                    yield from close()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield from close()

    return contexts.repartition(n, "gram", "shard").sortWithinPartitions("gram", "shard").mapInArrow(run, _FOUND_SQL)


class Run:
    """Windows in the order of their hash, one of each hash, the earliest."""

    def __init__(self, w1: np.ndarray, w2: np.ndarray, doc: np.ndarray, th: np.ndarray, lo: np.ndarray):
        by = np.lexsort((lo, th, doc, w2, w1))
        self.rows = np.stack([x[by] for x in (w1, w2, doc, th, lo)])

    def merge(self, other: Run) -> tuple[Run, np.ndarray]:
        """The merged run, and the rows that lost to an earlier equal window.  other's places are found by bisection."""
        a, b = self.rows, other.rows
        at = np.searchsorted(a[0], b[0])
        # walk over equal first halves (as good as never more than one)
        hit = np.full(b.shape[1], -1)
        go = np.flatnonzero(at < a.shape[1])
        step = at.copy()
        while len(go):
            go = go[(step[go] < a.shape[1])]
            go = go[a[0][step[go]] == b[0][go]]
            same = a[1][step[go]] == b[1][go]
            hit[go[same]] = step[go[same]]
            go = go[~same]
            step[go] += 1
        met = np.flatnonzero(hit >= 0)
        x, y = a[2:, hit[met]], b[2:, met]
        later = (y[0] < x[0]) | ((y[0] == x[0]) & ((y[1] < x[1]) | ((y[1] == x[1]) & (y[2] < x[2]))))
        equal = (x == y).all(0)
        lost = np.concatenate([x[:, later], y[:, ~later & ~equal]], axis=1)
        a = a.copy()
        a[2:, hit[met[later]]] = y[:, later]
        rest = b[:, hit < 0]
        out = Run.__new__(Run)
        out.rows = np.insert(a, at[hit < 0], rest, axis=1)
        order = np.lexsort((out.rows[1], out.rows[0]))
        out.rows = out.rows[:, order]
        return out, lost


def merge_shards(found: DataFrame, n: int) -> DataFrame:
    """Repeats among the earliest windows that different shards gave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[Run] = []
        for b in batches:
            cols = [b.column(n).to_numpy() for n in ("w1", "w2", "doc_id", "th", "lo")]
            new = Run(*cols)
            dup = np.append(False, (new.rows[:2, 1:] == new.rows[:2, :-1]).all(0)) if new.rows.shape[1] else np.zeros(0, bool)
            lost = [new.rows[2:, dup & np.append(False, ~(new.rows[2:, 1:] == new.rows[2:, :-1]).all(0))]] if len(dup) else []
            new.rows = new.rows[:, ~dup]
            while runs and runs[-1].rows.shape[1] <= 2 * new.rows.shape[1]:
                new, gone = runs.pop().merge(new)
                lost.append(gone)
            runs.append(new)
            yield from _lost(lost)
        while len(runs) > 1:
            small = runs.pop()
            big, gone = runs.pop().merge(small)
            runs.append(big)
            yield from _lost([gone])

    def _lost(lost: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(lost, axis=1) if lost else np.zeros((3, 0), np.int64)
        yield _batch(_FOUND[:4], doc_id=rows[0], th=rows[1], lo=rows[2], hi=rows[2])

    cut = found.where("w1 IS NOT NULL")
    return cut.repartitionByRange(n, "w1").mapInArrow(run, "doc_id long, th long, lo long, hi long")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, th and the windows lo..hi (first bytes) that also start earlier; null ids as the least long."""
    keyed, n = _keyed(docs), spread(docs)
    marks = materialise(judge_anchors(find_anchors(keyed), n), "marks")
    found = materialise(judge_contexts(open_contexts(keyed, marks), n), "windows")
    names = ["doc_id", "th", "lo", "hi"]
    return marks.where("shard IS NULL").select(names).union(found.where("w1 IS NULL").select(names)).union(merge_shards(found, n))


def remove_repeats(docs: DataFrame, outputs: tuple[str, ...] = ("kept",)) -> DataFrame:
    """For every row of docs: doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) or kept_sha256."""
    gone = repeats(docs).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("gone")).withColumnsRenamed({"doc_id": "d", "th": "t"})
    texts = _packed(_keyed(docs))
    kinds = {"kept": ("binary", pa.binary()), "kept_sha256": ("string", pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            n, removed, spans, kept = [], [], [], []
            for packed, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = z.decompress(packed)
                n.append(len(raw))
                if not found:
                    removed.append(0)
                    spans.append(0)
                    kept.append(raw)
                    continue
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, [x["lo"] for x in found], 1)
                np.add.at(edge, [x["hi"] + WINDOW for x in found], -1)
                cover = np.cumsum(edge[:-1]) > 0
                removed.append(int(cover.sum()))
                spans.append(int((np.diff(cover, prepend=False) & cover).sum()))
                kept.append(np.frombuffer(raw, np.uint8)[~cover].tobytes())
            cols = [pa.array(kept if o == "kept" else [hashlib.sha256(x).hexdigest() for x in kept], kinds[o][1]) for o in outputs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", *outputs])

    met = texts.join(gone, (_order("doc_id") == gone["d"]) & (texts["th"] == gone["t"]), "left").select("doc_id", "packed", "gone")
    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, " + ", ".join(f"{o} {kinds[o][0]}" for o in outputs))
