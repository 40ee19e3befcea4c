"""Phrase collocations by vertical positional inverted lists.

Texts are cut into shards of about SHARD_BYTES of one language.  A shard keeps, for each of its words, the sorted list of the
positions where it stands; a gap in the positions parts the pieces of a text.  A phrase is extended by merging its list, moved
on by its length, with the postings of the words there; the length of the new list is the phrase's frequency in the shard,
and the sum over shards its exact frequency.  Only words, and then only pairs, that are frequent in their whole language are
extended: an infrequent part makes no frequent phrase.

What travels between shards is counts: one per word, pair or triple that a shard holds, however often it holds it.  Pairs and
triples are dealt into parts by their word ids; those of one shard and part travel as one row, sorted, as packed differences.
A part adds them up; shards get their own frequent words and pairs back.  A word that every shard has is a row per shard.  The
shard that comes first among those of a frequent pair reports it; words are spelled when counts are whole.

Null languages are `und`, null texts empty.  Repeated rows count each; ids and other columns are not used.  Words keep all
characters but A-Z, which are lower-cased.  Ties: the least cut, then a, then the phrase in byte order, so ranks are fixed.
Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphaera.llm.common import bucketed, drop_table, materialise, spread

SHARD_BYTES = 10 << 20
#: Texts of so many bytes are split into words at once.
CHUNK_BYTES = 1 << 20
#: Marks that end a piece become line feeds, A-Z lower case, tabs spaces.
_MAP = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A language's candidates are ranked in so many parts first.
PARTS = 256


def _pack(values: np.ndarray) -> bytes:
    """Numbers below 2^32 as their differences within rising runs, byte by byte plane, compressed."""
    v = values.astype("<u4")
    step = np.diff(v, prepend=np.uint32(0))
    return zlib.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32).view(np.int32)


def shard_lists(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, length of each word's list, all lists one after another): positions skip one between pieces."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    numbers[b""], numbers[b"\n"]  # 0 and 1
    parts, held, size = [], [], 0

    def flush() -> None:
        tokens = " \n ".join([*held, ""]).encode().translate(_MAP).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
        parts.append(ids[ids > 0])
        held.clear()

    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= CHUNK_BYTES:
            flush()
            size = 0
    flush()
    ids = np.concatenate(parts)
    del parts
    at = np.flatnonzero(ids > 1).astype(np.int32)
    word = ids[at] - 2
    del ids
    order = np.argsort(word, kind="stable")
    return list(numbers)[2:], np.bincount(word, minlength=len(numbers) - 2), at[order]


SHARD = "lang string, words array<binary>, sizes array<int>, lists binary"


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, lang, words, sizes, lists: the inverted lists of all texts, written once."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("lists", pa.binary())])

    def made(lang: str, texts: list[str]) -> pa.RecordBatch:
        words, sizes, lists = shard_lists(texts)
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([words], pa.list_(pa.binary())), pa.array([sizes], pa.list_(pa.int32())), pa.array([_pack(lists)], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
                if size[lang] >= shard_bytes:
                    yield made(lang, held.pop(lang))
                    del size[lang]
                elif sum(size.values()) >= 2 * shard_bytes:  # many languages: the largest goes first
                    top = max(size, key=size.get)
                    yield made(top, held.pop(top))
                    del size[top]
        for lang in list(held):
            yield made(lang, held.pop(lang))

    src = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = src.mapInArrow(run, SHARD).where(F.size("words") > 0)
    return bucketed(found.withColumn("shard", F.monotonically_increasing_id()), "phrase_lists", "shard", spread(docs))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _pairs(position: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge of a list of positions, moved on by one, with itself: (place of the first, place of the second, position)."""
    near = np.flatnonzero(position[1:] == position[:-1] + 1)
    return name[near], name[near + 1], position[near]


def _counted(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct a * width + b, length of the list of each)."""
    return np.unique(a * np.int64(width) + b, return_counts=True)


def _word_rows(shard: DataFrame) -> DataFrame:
    word = F.explode(F.arrays_zip("words", "sizes", F.sequence(F.lit(0), F.size("words") - 1).alias("k"))).alias("w")
    return shard.select("shard", "lang", word).select("shard", "lang", F.col("w.words").alias("word"), F.col("w.sizes").cast("long").alias("c"), F.col("w.k").alias("k"))


def _known(parts: DataFrame, buckets: int, name: str, *columns: str) -> DataFrame:
    """shard and its rows in order: a shard's own words or pairs, bounded by its size."""
    return parts.repartition(buckets, "shard").groupBy("shard").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def _column(known: pa.Array, name: str) -> np.ndarray:
    return known.flatten().field(known.type.value_type.get_field_index(name)).to_numpy(zero_copy_only=False)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as their differences, sign last, byte by byte plane, compressed."""
    planes = []
    for v in columns:
        step = np.diff(v.astype("<i8"), prepend=np.int64(0))
        planes.append(np.ascontiguousarray(((step << 1) ^ (step >> 63)).view(np.uint8).reshape(-1, 8).T).tobytes())
    return zlib.compress(b"".join(planes), 1)


def _unpacked(raw: bytes, width: int) -> list[np.ndarray]:
    out = []
    for planes in np.frombuffer(zlib.decompress(raw), np.uint8).reshape(width, 8, -1):
        v = np.ascontiguousarray(planes.T).view("<u8").ravel()
        out.append(np.cumsum((v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64)))
    return out


def _dealt(parts: int, ids: list[np.ndarray], *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, rows packed in the order of their ids) for every part that has rows; a part is a hash of the ids."""
    h = np.zeros(len(ids[0]), np.uint64)
    for v in ids:
        h = (h ^ v.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    part = (h % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((*ids[::-1], part))
    edge = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, edge) if len(order) else []:
        yield int(part[rows[0]]), _packed(*(v[rows] for v in (*ids, *more)))


def _summed(ids: list[np.ndarray], c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by ids, where a new one begins in it, sum of c over each): equal ids keep their order."""
    order = np.lexsort(ids[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([np.diff(v[order]) != 0 for v in ids])
    return order, new, np.add.reduceat(c[order], np.flatnonzero(new))


def pair_counts(shard: DataFrame, parts: int) -> DataFrame:
    """part, shard, packed (ids of both words, count): pairs of frequent words in each shard."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                position, name, ids = _opened(row)
                a, c, _ = _pairs(position, name)
                del position, name
                key, n = _counted(a, c, len(ids))
                del a, c
                part, packed = zip(*_dealt(parts, [ids[key // len(ids)], ids[key % len(ids)]], n), strict=True) if len(key) else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([row.column(0)[0].as_py()] * len(part), pa.int64()), pa.array(packed, pa.binary())], schema=schema)

    return shard.select("shard", "sizes", "lists", "ids").mapInArrow(run, "part int, shard long, packed binary")


def frequent_pairs(counted: DataFrame, least: int) -> DataFrame:
    """shard, packed (ids of both words, whole count where the shard is the first to have the pair, else 0)."""
    schema = pa.schema([("shard", pa.int64()), ("packed", pa.binary())])

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("shard")
        shard, found = part["shard"].to_numpy(), [_unpacked(x, 3) for x in part["packed"].to_pylist()]
        owner = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        one, two, c = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        order, new, total = _summed([one, two], c)
        a = total[np.cumsum(new) - 1]
        keep = np.flatnonzero(a >= least)
        a = np.where(new, a, 0)[keep]
        rows = order[keep]
        by = np.argsort(owner[rows], kind="stable")
        rows, a = rows[by], a[by]
        edge = np.flatnonzero(np.diff(owner[rows])) + 1
        groups = list(zip(np.split(rows, edge), np.split(a, edge), strict=True)) if len(rows) else []
        return pa.table([pa.array([shard[owner[r[0]]] for r, _ in groups], pa.int64()), pa.array([_packed(one[r], two[r], x) for r, x in groups], pa.binary())], schema=schema)

    return counted.groupBy("part").applyInArrow(run, "shard long, packed binary")


def frequent_lists(shard: DataFrame) -> DataFrame:
    """shard, lang, words, sizes, lists, ids, f: the shards cut to the words they are known to share with `known`."""
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("lists", pa.binary()), ("ids", pa.list_(pa.int64())), ("f", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                known = row.column(5)
                local = _column(known, "k").astype(np.int64)
                sizes, lists = row.column(3).flatten().to_numpy().astype(np.int64), _unpack(row.column(4)[0].as_py())
                n = sizes[local]
                lists = lists[np.repeat(_starts(sizes)[local] - _starts(n), n) + np.arange(n.sum())]
                one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                words = row.column(2).flatten().take(pa.array(local))
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), one(n.astype(np.int32), pa.int32()), pa.array([_pack(lists)], pa.binary()), one(_column(known, "id"), pa.int64()), one(_column(known, "f"), pa.int64())], schema=schema)

    rows = shard.select("shard", "lang", "words", "sizes", "lists", "known")
    return rows.mapInArrow(run, "shard long, lang string, words array<binary>, sizes array<int>, lists binary, ids array<long>, f array<long>")


def _opened(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions and words of a shard's lists merged, by position; ids of its words)."""
    sizes = row.column(row.schema.get_field_index("sizes")).flatten().to_numpy()
    position = _unpack(row.column(row.schema.get_field_index("lists"))[0].as_py())
    order = np.argsort(position)
    name = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    return position[order], name, row.column(row.schema.get_field_index("ids")).flatten().to_numpy()


def phrase_counts(shard: DataFrame, parts: int) -> DataFrame:
    """part, words, packed: frequent pairs once, with their whole count, and the triples of each shard with its own count."""
    schema = pa.schema([("part", pa.int32()), ("words", pa.int32()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                one, two, total = (np.concatenate(x) for x in zip(*(_unpacked(x, 3) for x in row.column(4)[0].as_py()), strict=True))
                position, name, ids = _opened(row)
                order = np.argsort(ids)
                left, right = (order[np.searchsorted(ids, x, sorter=order)] for x in (one, two))
                key = left * np.int64(len(ids)) + right
                by = np.argsort(key)
                key, one, two, total = key[by], one[by], two[by], total[by]
                mine = np.flatnonzero(total)
                out = [(p, 2, x) for p, x in _dealt(parts, [one[mine], two[mine]], total[mine])]
                # the lists of the frequent pairs, merged with themselves one position on
                a, c, at = _pairs(position, name)
                del position, name, left, right
                a = a * np.int64(len(ids)) + c
                pair = np.searchsorted(key, a)
                keep = key[np.minimum(pair, len(key) - 1)] == a
                p, q, _ = _pairs(at[keep], pair[keep])
                del a, c, at, pair, keep
                triple, n = _counted(p, q, len(key))
                p, q = triple // len(key), triple % len(key)
                out += [(k, 3, x) for k, x in _dealt(parts, [one[p], two[p], two[q]], n)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 3, schema, strict=True)], schema=schema)

    return shard.select("shard", "sizes", "lists", "ids", "pairs").mapInArrow(run, "part int, words int, packed binary")


def candidates(counted: DataFrame, least: int) -> DataFrame:
    """one, two, three (ids of the words, null in pairs), a: phrases that occur `least` times."""
    schema = pa.schema([(c, pa.int64()) for c in ("one", "two", "three", "a")])

    def run(part: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        for words in (2, 3):
            found = [_unpacked(x, words + 1) for w, x in zip(part["words"].to_pylist(), part["packed"].to_pylist(), strict=True) if w == words]
            if found:
                *ids, c = (np.concatenate(x) for x in zip(*found, strict=True))
                order, new, total = _summed(ids, c)
                rows = order[new][total >= least]
                cells = [pa.array(v[rows]) for v in ids] + [pa.nulls(len(rows), pa.int64())] * (3 - words)
                out.append(pa.table([*cells, pa.array(total[total >= least])], schema=schema))
        return pa.concat_tables(out)

    return counted.groupBy("part").applyInArrow(run, "one long, two long, three long, a long")


def _score(l: str, r: str) -> Column:
    """floor(1000000 a a / (l r)), exact for counts up to 10^16."""
    d = "cast({} as decimal(16, 0))"
    return F.expr(f"(({d.format('a')} * {d.format('a')}) * cast(1000000 as decimal(7, 0))) div ({d.format(l)} * {d.format(r)})")


def mine(docs: DataFrame, least: int = 10, cover: int = 50, top: int = 2000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` collocations of two and three words of every language.

    least: occurrences that make a phrase a candidate.  A candidate is dropped where a longer one that holds it has at least
    `cover` in a hundred of its occurrences.
    """
    lists, buckets = shards(docs, shard_bytes), spread(docs)
    rows = _word_rows(lists)
    words = materialise(rows.groupBy("lang", "word").agg(F.sum("c").alias("f")).withColumn("id", F.monotonically_increasing_id()), "phrase-words")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    own = rows.select("shard", "lang", "word", "k").join(words.where(F.col("f") >= least), ["lang", "word"])
    opened = bucketed(frequent_lists(lists.join(_known(own, buckets, "known", "k", "id", "f"), "shard")), "phrase_frequent_lists", "shard", buckets)
    drop_table(lists)
    pairs = frequent_pairs(pair_counts(opened, buckets), least).repartition(buckets, "shard").groupBy("shard").agg(F.collect_list("packed").alias("pairs"))
    found = materialise(candidates(phrase_counts(opened.join(pairs, "shard"), buckets), least), "phrase-candidates")
    drop_table(opened)
    spelled = lambda at, name, f: words.where(F.col("f") >= least).select(F.col("id").alias(at), F.col("word").cast("string").alias(name), F.col("f").alias(f), "lang")
    two = materialise(found.where("three is null").drop("three").join(spelled("one", "w1", "l"), "one").join(spelled("two", "w2", "r").drop("lang"), "two"), "phrase-pairs")
    three = found.where("three is not null")
    held = F.array(F.struct(F.col("one").alias("x"), F.col("two").alias("y")), F.struct(F.col("two").alias("x"), F.col("three").alias("y")))
    longer = three.select(F.explode(held).alias("p"), "a").groupBy(F.col("p.x").alias("one"), F.col("p.y").alias("two")).agg(F.max("a").alias("longer"))
    short = two.join(longer, ["one", "two"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    short = short.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("l", "r").alias("score"))
    one = two.select("one", "two", "lang", "w1", "w2", F.col("l").alias("l1"), F.col("a").alias("l2"))
    last = two.select(F.col("one").alias("two"), F.col("two").alias("three"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    long = three.join(one, ["one", "two"]).join(last, ["two", "three"]).withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3")).withColumn("s1", _score("l1", "r1")).withColumn("s2", _score("l2", "r2"))
    second = F.col("s2") < F.col("s1")
    scored = short.unionByName(long.select("lang", "phrase", "a", *(F.when(second, F.col(y)).otherwise(F.col(x)).alias(n) for x, y, n in (("l1", "l2", "l"), ("r1", "r2", "r"), ("s1", "s2", "score")))))
    order = (F.desc("score"), F.desc("a"), "phrase")
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "part")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
