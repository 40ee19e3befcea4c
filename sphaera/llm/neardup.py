"""Near-duplicate groups by SuperMinHash.

1.  Every document becomes the set of its word shingles (64-bit hashes).  Equal sets are represented by their least id.
2.  SuperMinHash: element e visits the slots in an order drawn from e, and at its j-th slot offers j + r, r in [0, 1).
    A slot keeps its least offer.  Once every slot of a document holds less than j no later offer can win, so the steps
    stop early; one document after another drops out of the vectorised steps.
3.  Signatures are cut into bands.  In each band bucket every member is paired with the least one (a star, not all pairs)
    and confirmed on the full sets of the whole texts.
4.  Components of the confirmed links; then, for every cluster (component of the unconfirmed stars) that still holds
    several of them, members outside its largest component meet all others in blocks of sketches.  Block pairs in which
    signatures of different components agree enough meet with their texts, and all such pairs are confirmed on full sets.
    Pairs in one component need no check, so no link between different texts is lost by the star.

With 32 bands of 4 rows a pair at similarity 0.8 fails to meet with probability 5e-8.  min_agreement (of 128 signature
slots, 0.55 by default for a limit of 0.8) lies seven standard deviations under the limit.

Null texts are empty; documents without words have the empty set, no links, and stand alone.  A null id cannot be named
in a link: such rows stand alone with a null component and are kept.  Rows of one id belong together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.llm.common import doc_texts, materialise
from sphaera.llm.components import components

SLOTS, BANDS = 128, 32
ROWS = SLOTS // BANDS
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle of its own kind."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        out = mix(h[: len(h) - n + 1] + np.uint64(n) * _GOLD)
        for k in range(1, n):
            out = mix(out * _GOLD + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def superminhash(elements: np.ndarray, owner: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_docs x slots, float64; inf without elements).  owner: document number of every element."""
    sig = np.full((n_docs, slots), np.inf)
    flat = sig.reshape(-1)
    order = None
    e, own = elements, owner.astype(np.int64)
    for j in range(slots):
        if j:
            open_docs = sig.max(1) >= j
            go = open_docs[own]
            if not go.all():
                e, own = e[go], own[go]
                order = order[go] if order is not None else None
            if not len(e):
                break
        with np.errstate(over="ignore"):
            u = mix(e + np.uint64(2 * j + 1) * _GOLD)
            pick = mix(u ^ _GOLD)
        r = (u >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + (pick % np.uint64(slots - j)).astype(np.int64)
        if j == 0:
            slot, first = k, (e, k)
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(e), 1))
                with np.errstate(over="ignore"):
                    back = (mix(mix(e + _GOLD) ^ _GOLD) % np.uint64(slots)).astype(np.int64)
                at = np.arange(len(e))
                order[at, back], order[:, 0] = 0, order[at, back]
            at = np.arange(len(e))
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
            order[:, j] = slot
        np.minimum.at(flat, own * slots + slot, r + j)
    return sig


def signatures(texts: list[bytes], width: int, most: int = 150_000) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Shingle sets and signatures of runs of texts; a run ends at about `most` shingles."""
    sets: list[np.ndarray] = []
    size = 0
    for t in texts:
        sets.append(shingles(t, width))
        size += len(sets[-1])
        if size >= most:
            yield sets, superminhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))
            sets, size = [], 0
    if sets:
        yield sets, superminhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))


def band_keys(sig: np.ndarray) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = mix(np.arange(BANDS, dtype=np.uint64)[None, :] + _GOLD)
        for k in range(ROWS):
            key = mix(key * _GOLD + bits[:, :, k])
    return key.view(np.int64)


def profile(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key, bands (longs) and sketch (a byte per slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, at = b.column(0), b.column(1).cast(pa.binary()).to_pylist(), 0
            for sets, sig in signatures(texts, width):
                n = len(sets)
                sketch = (mix(sig.view(np.uint64)) & np.uint64(255)).astype(np.uint8)
                key = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(list(band_keys(sig)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in sketch], pa.binary())], names=["doc_id", "n_shingles", "set_key", "bands", "sketch"])
                at += n

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed) of the documents in ids: whole texts, compressed before they travel."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(t) for t in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "packed"])

    return doc_texts(docs).mapInArrow(pack, "doc_id long, packed binary").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


class FullSets:
    """Shingle sets of packed texts; the latest few are kept."""

    def __init__(self, width: int, most: int = 64):
        self.width, self.most, self.known, self.z = width, most, {}, zstandard.ZstdDecompressor()

    def get(self, i: int, packed: bytes) -> np.ndarray:
        if i not in self.known:
            if len(self.known) >= self.most:
                self.known.pop(next(iter(self.known)))
            self.known[i] = shingles(self.z.decompress(packed), self.width)
        return self.known[i]


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are alike on their full sets.  Texts join by id: joins that can be split where one is hot."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = FullSets(width)
        for batch in batches:
            r = batch.to_pydict()
            good = [alike(sets.get(a, ta), sets.get(b, tb), percent) for a, b, ta, tb in zip(r["a"], r["b"], r["ta"], r["tb"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("ta")), "a")
    return left.join(texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("tb")), "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _blocks(members: DataFrame, size: DataFrame, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """cluster, rest, no, rows: the members of the clusters in size, in blocks; rest: outside the largest component."""
    cut = members.join(size, "cluster").withColumn("rest", F.col("component") != F.col("main"))
    cut = cut.withColumn("no", F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("b_rest")).otherwise(F.col("b_main"))).cast("int"))
    keys = ["cluster", "rest", "no"]
    return cut.select("id", "component", *keys).join(rows, "id").groupBy(*keys).agg(F.collect_list(F.struct("id", "component", *columns)).alias("rows"))


def _met(blocks: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Blocks of the rest beside all blocks of their cluster, each two once; or the pairs of blocks given."""
    if pairs is None:
        names = blocks.select("cluster", "rest", "no")
        one = names.where("rest").select("cluster", F.col("no").alias("no_a"))
        pairs = one.join(names.select("cluster", F.col("rest").alias("rest_b"), F.col("no").alias("no_b")), "cluster").where("NOT rest_b OR no_a <= no_b")
    left = blocks.where("rest").select("cluster", F.col("no").alias("no_a"), F.col("rows").alias("rows_a"))
    right = blocks.select("cluster", F.col("rest").alias("rest_b"), F.col("no").alias("no_b"), F.col("rows").alias("rows_b"))
    return pairs.join(left, ["cluster", "no_a"]).join(right, ["cluster", "rest_b", "no_b"]).select("cluster", "no_a", "rest_b", "no_b", "rows_a", "rows_b")


def _sketches(side: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(m["sketch"] for m in side), np.uint8).reshape(len(side), -1)


def agreeing(blocks: DataFrame, min_agreement: float) -> DataFrame:
    """The pairs of blocks (rows with id, component, sketch) in which any two members of different components agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                q, cy = _sketches(y), np.array([m["component"] for m in y])
                keep.append(any(((q == row).mean(1) >= min_agreement)[cy != m["component"]].any() for row, m in zip(_sketches(x), x, strict=True)))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["cluster", "no_a", "rest_b", "no_b"]).filter(pa.array(keep, pa.bool_()))

    return _met(blocks).mapInArrow(run, "cluster long, no_a int, rest_b boolean, no_b int")


def crossing_links(members: DataFrame, rows: DataFrame, texts: DataFrame, min_agreement: float, width: int, percent: int, block: int = 128) -> DataFrame:
    """Links between different components of one cluster.

    members: id, cluster (component over unconfirmed stars), component (over confirmed ones); rows: id, sketch; texts:
    doc_id, packed.  Members outside a cluster's largest component meet all others in blocks of sketches.  Only block
    pairs with members that agree enough meet again with their texts, and give at most one link for each member and
    component.
    """
    parts = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    size = parts.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
    size = materialise(size.select("cluster", F.col("top.component").alias("main"), F.ceil(F.col("top.n") / block).cast("int").alias("b_main"), F.ceil((F.col("n") - F.col("top.n")) / block).cast("int").alias("b_rest")), "clusters")
    blocks = materialise(_blocks(members, size, rows, ("sketch",)), "blocks")
    left = materialise(agreeing(blocks, min_agreement), "agreeing")
    sides = left.select("cluster", F.lit(True).alias("rest"), F.col("no_a").alias("no")).union(left.select("cluster", F.col("rest_b").alias("rest"), F.col("no_b").alias("no"))).distinct()
    packed = blocks.join(sides, ["cluster", "rest", "no"], "left_semi").select("cluster", "rest", "no", F.explode("rows").alias("m")).select("cluster", "rest", "no", "m.*")
    packed = packed.join(texts.select(F.col("doc_id").alias("id"), "packed"), "id").groupBy("cluster", "rest", "no").agg(F.collect_list(F.struct("id", "component", "sketch", "packed")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = FullSets(width, 2 * block)
        for b in batches:
            for r in range(b.num_rows):
                x, y = b.column(4)[r].as_py(), b.column(5)[r].as_py()
                p, q = _sketches(x), _sketches(y)
                out: list[tuple[int, int]] = []
                for i, m in enumerate(x):
                    near = (q == p[i]).mean(1)
                    linked = {m["component"]}
                    for j in np.argsort(-near, kind="stable").tolist():
                        if near[j] < min_agreement:
                            break
                        if y[j]["component"] not in linked and alike(sets.get(m["id"], m["packed"]), sets.get(y[j]["id"], y[j]["packed"]), percent):
                            linked.add(y[j]["component"])
                            out.append((m["id"], y[j]["id"]))
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["a", "b"])

    return _met(materialise(packed, "packed"), left).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, min_agreement: float = 0.55) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable) and kept, one row per row of docs."""
    found = materialise(profile(docs, width), "profiles")
    usable = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # partial least ids first, and a table of its own for the join, so that one set's many copies can be split
    reps = materialise(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "reps")
    stood = usable.select("doc_id", "set_key").join(reps.where("n > 1").select("set_key", "rep"), "set_key").where("doc_id != rep").select("doc_id", "rep")
    heads = usable.join(reps.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi").dropDuplicates(["doc_id", "set_key"])
    rows = heads.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = materialise(rows.join(buckets.select("bucket", "b"), "bucket").where("id != b").select(F.col("id").alias("a"), "b").distinct(), "stars")
    clusters = components(stars).withColumnRenamed("component", "cluster")
    texts = materialise(packed_texts(docs, clusters.select(F.col("id").alias("doc_id"))), "texts")
    first = components(confirm(stars, texts, width, percent))
    members = materialise(clusters.join(first, "id", "left").select("id", "cluster", F.coalesce("component", "id").alias("component")), "members")
    second = crossing_links(members, heads.select(F.col("doc_id").alias("id"), "sketch"), texts, min_agreement, width, percent)
    joined = first.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a != b").union(second)
    # rows of one id are one document
    whole = components(joined.union(stood))
    out = found.select("doc_id", "n_shingles").join(whole.select(F.col("id").alias("doc_id"), "component").dropDuplicates(["doc_id"]), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id stands first in its group, all columns kept: all rows of that id, and all rows of null id.

    Of several texts under one id only one is compared with other texts on its full set.
    """
    out = near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(out, docs["doc_id"].cast("long") == out["_gone"], "left_anti")
