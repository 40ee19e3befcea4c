"""Benchmark decontamination: n-gram seeds find places, Smith-Waterman alignment scores them.

Words are runs of letters, digits and bytes above 127, with A-Z lower-cased.  Every three neighbouring words of a test
item are a seed, however common they are; items of one or two words are a seed as a whole.  So every item that has a
word is searched, in corpora of every size and skew.  A seed found in a document opens a window around the place where
the item would lie.  Windows with too few of the item's words to reach the least score are left out, and the item is
aligned locally to the others: +1 for equal words, -1 for others, -1 a gap.  The score is the best alignment divided by
the item's number of words; 1.0 is a full copy.

The test set goes to the workers in blocks of at most block_bytes of text, one scan of the documents per block, so its
size is no limit.  Null texts and items are empty and match nothing; rows with a null id are matched like others.
Repeated documents are judged one by one; of repeated (document, item) rows the best score is kept, and equal scores of
several items all stay.  Texts of any length are searched whole; a window is about as long as its item, of any length.
Columns other than the ids and texts are not read; clean() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.llm.common import doc_texts
from sphaera.llm.neardup import mix

SEED_WORDS = 3
#: Documents that are searched together; bounds the working memory of a task.
RUN_DOCS = 1000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_WORD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_WORD).split()


def align(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best local alignment score of item (word numbers) in each row of windows (padded with -2)."""
    best = np.zeros(len(windows), np.int32)
    ramp = np.arange(windows.shape[1] + 1, dtype=np.int32)
    above = np.zeros((len(windows), windows.shape[1] + 1), np.int32)
    for w in item:
        row = np.zeros_like(above)
        row[:, 1:] = above[:, :-1] + np.where(windows == w, 1, -1)
        row = np.maximum(np.maximum(row, above - 1), 0)
        row[:, 0] = 0
        above = np.maximum.accumulate(row + ramp, axis=1) - ramp
        best = np.maximum(best, above.max(1))
    return best


class Matcher:
    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.number: dict[bytes, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        for item_id, raw in items:
            ws = words(raw)
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in ws], np.int64)
            self.items.append((item_id, ids))
        cols: list[list[np.ndarray]] = [[], [], []]
        for k, (_, ids) in enumerate(self.items):
            if n := min(SEED_WORDS, len(ids)):
                key = self._keys([ids[j : len(ids) - n + 1 + j] for j in range(n)])
                for c, x in zip(cols, (key, np.full(len(key), k), np.arange(len(key))), strict=True):
                    c.append(x)
        key, of, at = (np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(cols, (np.uint64, np.int64, np.int64), strict=True))
        order = np.lexsort((at, of, key))
        self.of, self.at = of[order], at[order]
        self.keys, first = np.unique(key[order], return_index=True)
        self.bounds = np.append(first, len(key))
        self.margin = np.array([max(4, len(ids) // 4) for _, ids in self.items], np.int64)
        self.short = sorted({min(SEED_WORDS, len(ids)) for _, ids in self.items if len(ids)})

    @staticmethod
    def _keys(parts: list[np.ndarray]) -> np.ndarray:
        """Hashes of the seeds whose first, second, ... words are in parts.  Two seeds that share one only cost an
        alignment more."""
        key = np.full(len(parts[0]), len(parts), np.uint64)
        with np.errstate(over="ignore"):
            for p in parts:
                key = mix(key * _GOLD + p.astype(np.uint64))
        return key

    def places(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(item, first word of the window) for all seeds in a document, near-equal places once."""
        out = set()
        for n in self.short:
            if len(ids) < n:
                continue
            parts = [ids[k : len(ids) - n + 1 + k] for k in range(n)]
            pos = np.flatnonzero(np.min(parts, axis=0) >= 0)
            if not len(pos) or not len(self.keys):
                continue
            key = self._keys([p[pos] for p in parts])
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[slot] == key
            pos, slot = pos[hit], slot[hit]
            each = self.bounds[slot + 1] - self.bounds[slot]
            row = np.arange(int(each.sum())) + np.repeat(self.bounds[slot] - (np.cumsum(each) - each), each)
            k = self.of[row]
            step = self.margin[k]
            out.update(zip(k.tolist(), ((np.repeat(pos, each) - self.at[row]) // step * step).tolist(), strict=True))
        return sorted(out)

    def scores(self, docs: list[np.ndarray], min_score: float = 0.0) -> Iterator[tuple[int, int, float]]:
        """(document number, item number, score) of every document and item that share a seed and can reach min_score."""
        by_item: dict[int, list[tuple[int, int]]] = {}
        for d, ids in enumerate(docs):
            for k, p in self.places(ids):
                by_item.setdefault(k, []).append((d, p))
        for k, found in by_item.items():
            item, m = self.items[k][1], int(self.margin[k])
            width = len(item) + 3 * m
            best: dict[int, int] = {}
            step = max(1, 500_000 // width)
            for lo in range(0, len(found), step):
                part = found[lo : lo + step]
                win = np.full((len(part), width), -2, np.int64)
                for i, (d, p) in enumerate(part):
                    cut = docs[d][max(0, p - m) : max(0, p - m + width)]
                    win[i, : len(cut)] = cut
                may = np.flatnonzero(np.isin(win, item).sum(1) / len(item) >= min_score)  # a score is at most the equal words
                for i, s in zip(may.tolist(), align(item, win[may]).tolist(), strict=True):
                    d = part[i][0]
                    best[d] = max(best.get(d, 0), s)
            for d, s in best.items():
                yield d, k, s / len(item)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = 0.4, max_chance: float = 1e-7, block_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, item_id, score of every pair that reaches min_score.  max_chance is still taken but cuts nothing."""
    src = doc_texts(docs)
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().collect()
        texts = [(r["item_id"], r["text"].encode("utf-8", "surrogatepass")) for r in rows]
        matcher = spark.sparkContext.broadcast(Matcher(texts))

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            m = matcher.value
            get = m.number.get
            for b in (batch.slice(lo, RUN_DOCS) for batch in batches for lo in range(0, batch.num_rows, RUN_DOCS)):
                numbered = [np.array([get(w, -1) for w in words(raw)], np.int32) for raw in b.column(1).cast(pa.binary()).to_pylist()]
                found = [(d, m.items[k][0], s) for d, k, s in m.scores(numbered, min_score) if s >= min_score]
                ids = b.column(0).take(pa.array([d for d, _, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.float64())], names=["doc_id", "item_id", "score"])

        part = src.mapInArrow(run, "doc_id long, item_id long, score double")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def clean(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """The rows of docs that match no item, all columns kept."""
    hit = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["_hit"]), "left_anti")
