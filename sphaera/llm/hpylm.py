"""Language-model scoring with a hierarchical Pitman-Yor model over words.

Tokens are words with A-Z lower-cased, then one end per text.  Every word has a restaurant: its customers are the tokens
that follow the word, and the start of a text has one too.  Tables of these context restaurants are customers of the
root restaurant, which has no context; a new table there is a new word (the root's parent is diffuse), so the root's
predictive probability holds a share for "any other word", and every prediction is over the V training tokens and that
one outcome.  A token after context u has probability (c - d t) / (s + c_u) + (s + d t_u) / (s + c_u) * root(w).

Seating is sampled by Gibbs in blocks (see seating.py): the number of tables of each word of a context restaurant is drawn
at once, given the restaurant's other tables and the root's predictive probabilities; then the root takes the tables' averages over the samples as its customers, and so
on for `rounds` rounds, each with a burn-in of its own.  Restaurants see the root as it was at the round's beginning.
Scores use the averages of the last round's samples.  Discounts are estimated from the counts of ones and twos.

Spread over the cluster, nothing of it collected:

1.  Chunks of whole documents are written as files of word numbers, with the chunk's distinct words as 96-bit digests.
2.  Digests meet by range; a word's global number is the rank of its digest, so it does not depend on the layout.
3.  Chunks send their distinct (context, word) pairs to buckets of whole restaurants.  A restaurant of more than a
    bucket's share of all tokens (fewer of them than buckets) is dealt over all buckets by word; its parts know the
    other parts' tables as of the round before.
4.  Buckets exchange tables and root customers with ranges of words, sample, and answer the chunks' pairs with
    log-probabilities, in the order asked.  Chunks add them up by document.

The number of buckets follows from the number of training tokens alone, and all random numbers from the word numbers:
results are the same for every layout of the input.  Memory of a task goes by chunk_tokens (or the longest text) and by
bucket_tokens.

Null texts are empty: one end token.  Without training documents all counts are 0 and every token has probability 1, the
root's share of other words.  Repeated rows are scored one by one; rows with a null id learn or not by the crc32 of the
empty string.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphaera.llm.blobs import groups, load, save, squeeze, steps, table, unsqueeze
from sphaera.llm.common import doc_texts, drop_written, materialise, new_folder, remainder, spread, written
from sphaera.llm.neardup import mix
from sphaera.llm.seating import sample_tables

END_OF_TEXT = b"\n"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
STRENGTH, ROOT_STRENGTH = 1.0, 10.0
BURN_IN, SAMPLES = 2, 3


class _Numbers(dict):
    """Numbers for words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in text.split(", "))])


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1, 0.95))


# 1. chunks

_CHUNK = "chunk string, place string, tokens long, docs long"


def write_chunks(docs: DataFrame, folder: str, chunk_tokens: int) -> DataFrame:
    """docs: doc_id, text, learns.  A row for every chunk: place, and the tokens and documents that are learned from."""
    schema = _schema(_CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, part = 0, TaskContext.get().partitionId()
        flat, size, ids, learns, words = array("I"), [], [], [], _Numbers()

        def close() -> pa.RecordBatch:
            names = list(words)
            digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, names)), ">u8").reshape(-1, 2)
            hi, lo = digest[:, 0].astype(np.uint64), digest[:, 1].astype(np.uint64) >> np.uint64(32)
            order = np.lexsort((lo, hi))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            number, n, train = rank[np.frombuffer(flat, np.uint32)], np.array(size, np.int64), np.array(learns, bool)
            count = np.bincount(number[np.repeat(train, n)], minlength=len(order))
            known = np.array([d is not None for d in ids], bool)
            plain = np.array([d or 0 for d in ids], np.int64)
            place = save(folder, f"chunk-{part:06d}-{no:05d}", squeeze(steps(hi[order]), lo[order], count), squeeze(number), squeeze(n, train.astype(np.int64), known.astype(np.int64), plain.view(np.uint64)))
            return table(schema, [(f"{part}-{no}", place, int(n[train].sum()), int(train.sum()))])

        for b in batches:
            for doc, raw, learn in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                before = len(flat)
                flat.extend(map(words.__getitem__, raw.lower().split()))
                flat.append(words[END_OF_TEXT])
                size.append(len(flat) - before)
                ids.append(doc)
                learns.append(learn)
                if len(flat) >= chunk_tokens:
                    yield close()
                    flat, size, ids, learns, words = array("I"), [], [], [], _Numbers()
                    no += 1
        if size:
            yield close()

    return materialise(docs.mapInArrow(run, _CHUNK), "chunks")


# 2. words

_DEALT = "target long, place string, chunk string, blob binary"
_NUMBERED = "chunk string, part long, blob binary, types long, known long, tokens long, hot binary"


def number_words(chunks: DataFrame, parts: int, n: int, tokens: int, buckets: int) -> DataFrame:
    """For every chunk and range of digests the ranks and counts of its words; for every range (chunk null) its sizes and
    the words of more than a bucket's share of the tokens."""
    dealt, out = _schema(_DEALT), _schema(_NUMBERED)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, place in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                gap, lo, c = unsqueeze(load(place, 0)[0])
                hi = np.cumsum(gap.astype(np.uint64), dtype=np.uint64)
                edge = np.searchsorted(((hi >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1))
                yield table(dealt, [(k, place, chunk, squeeze(steps(hi[i:j]), lo[i:j], c[i:j])) for k, (i, j) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if i < j])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groups(batches):
            cols = [unsqueeze(r[2]) for r in rows]
            hi = np.concatenate([np.cumsum(x[0].astype(np.uint64), dtype=np.uint64) for x in cols])
            lo, c = (np.concatenate([x[k].astype(np.int64) for x in cols]) for k in (1, 2))
            order = np.lexsort((lo, hi))
            new = np.append(True, (np.diff(hi[order]) != 0) | (np.diff(lo[order]) != 0))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(new) - 1
            total = np.bincount(rank, c).astype(np.int64)
            edge = np.cumsum([0, *(len(x[0]) for x in cols)])
            for r, i, j in zip(rows, edge[:-1], edge[1:], strict=True):
                yield table(out, [(r[1], part, squeeze(steps(rank[i:j]), total[rank[i:j]]), None, None, None, None)])
            hot = np.flatnonzero(total * buckets > tokens)
            yield table(out, [(None, part, None, len(total), int((total > 0).sum()), int(total.sum()), squeeze(hot, total[hot]))])

    asked = chunks.mapInArrow(deal, _DEALT).repartition(n, "target").sortWithinPartitions("target", "place")
    return materialise(asked.mapInArrow(meet, _NUMBERED), "numbered")


# 3. pairs


def bucket_of(u: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each pair: by context, for hot contexts by word as well."""
    with np.errstate(over="ignore"):
        key = mix(u.astype(np.uint64) * _GOLD + np.where(hot, w.astype(np.uint64) + np.uint64(1), np.uint64(0)))
    return (key % np.uint64(buckets)).astype(np.int64)


def ask_pairs(numbered: DataFrame, chunks: DataFrame, folder: str, offset: list[int], n: int, tokens: int, docs: int, kinds: int, buckets: int) -> DataFrame:
    """Rows for the buckets: a chunk's pairs of each; and one row per chunk (target < 0) with the place of its documents.

    The documents' file holds each document's distinct pairs and the base score, which needs the words' counts only.
    """
    dealt = _schema(_DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in groups(batches):
            place = next(r[1] for r in rows if r[0] < 0)
            answers = [(r[0], *unsqueeze(r[2])) for r in rows if r[0] >= 0]
            word = np.concatenate([offset[k] + np.cumsum(x.astype(np.int64)) for k, x, _ in answers])
            count = np.concatenate([c.astype(np.int64) for _, _, c in answers])
            body, head = load(place, 1, 2)
            number = unsqueeze(body)[0].astype(np.int64)
            size, train, known, ids = unsqueeze(head)
            doc = np.repeat(np.arange(len(size)), size)
            begins = np.cumsum(size) - size
            base = np.bincount(doc, np.log10((count + 1) / (tokens + kinds + 1))[number], len(size))
            n_known = np.bincount(doc, count[number] > 0, len(size)).astype(np.int64)
            before = np.empty(len(number), np.int64)
            before[1:] = number[:-1] + 1
            before[begins] = 0
            key = before * (len(word) + 1) + number
            order = np.argsort(key)
            new = np.append(True, np.diff(key[order]) != 0) if len(key) else np.zeros(0, bool)
            pair = np.empty(len(key), np.int64)
            pair[order] = np.cumsum(new) - 1
            kind = key[order][new]
            del key, order, before
            c = np.bincount(pair[np.repeat(train.astype(bool), size)], minlength=len(kind))
            u, w = np.divmod(kind, len(word) + 1)
            # every token but the end stands before another one, so a context has its word's count
            hot = np.append(docs, count)[u] * buckets > tokens
            u, w = np.append(-1, word)[u] + 1, word[w]
            bucket = bucket_of(u, w, hot, buckets)
            order = np.argsort(bucket, kind="stable")
            where = np.empty(len(order), np.int64)
            where[order] = np.arange(len(order))
            own = np.sort((doc << 32) | where[pair])
            gap = np.diff(own & 0xFFFFFFFF, prepend=0)
            gap[begins] = own[begins] & 0xFFFFFFFF
            docs_at = save(folder, f"documents-{chunk}", squeeze(gap), squeeze(size, train, known, ids.astype(np.uint64), n_known), squeeze(base))
            u, w, c, bucket = u[order], w[order], c[order], bucket[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            out = [(-1 - int(xxhash.xxh3_64_intdigest(chunk) % n), docs_at, chunk, None)]
            for k, (i, j) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                if i < j:
                    out.append((k, None, chunk, _pack_pairs(u[i:j], w[i:j], c[i:j])))
            yield table(dealt, out)

    rows = numbered.where("chunk IS NOT NULL").select("chunk", "part", F.lit(None).cast("string").alias("place"), "blob")
    rows = rows.unionByName(chunks.select("chunk", F.lit(-1).cast("long").alias("part"), "place", F.lit(None).cast("binary").alias("blob")))
    return rows.repartition(n, "chunk").sortWithinPartitions("chunk", "part").mapInArrow(run, _DEALT)


def _pack_pairs(u: np.ndarray, w: np.ndarray, *more: np.ndarray) -> bytes:
    """Pairs in ascending order: contexts once with their number of pairs, words by their steps within a context."""
    head = np.flatnonzero(np.diff(u, prepend=-1))
    gap = np.diff(w, prepend=0)
    gap[head] = w[head]
    return squeeze(steps(u[head]), np.diff(np.append(head, len(u))), gap, *more)


def _unpack_pairs(raw: bytes) -> list[np.ndarray]:
    own, size, gap, *more = (x.astype(np.int64) if x.dtype.kind != "f" else x for x in unsqueeze(raw))
    total = np.cumsum(gap)
    head = np.cumsum(size) - size
    w = total - np.repeat(total[head] - gap[head], size)
    return [np.repeat(np.cumsum(own), size), w, *more]


# 4. buckets

_BUCKET = "bucket long, place string, ones long, twos long, hot binary, chunk string"
_MARGIN = "target long, bucket long, place string, blob binary"


def open_buckets(asked: DataFrame, folder: str, n: int, hot_words: np.ndarray) -> DataFrame:
    """Files of the buckets: the distinct pairs with their counts, their distinct words, and where each chunk's pairs lie.

    A row per bucket with its place, its pairs met once and twice, and its part of the hot contexts (customers, tables at
    least); and a row per chunk with the place of its documents.
    """
    out = _schema(_BUCKET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in groups(batches):
            if bucket < 0:
                yield table(out, [(None, r[0], None, None, None, r[1]) for r in rows])
                continue
            cols = [_unpack_pairs(r[2]) for r in rows]
            u, w, c = (np.concatenate([x[k] for x in cols]) for k in range(3))
            own, at = np.unique(u, return_inverse=True)
            key = at * (int(w.max()) + 1) + w
            order = np.argsort(key)
            new = np.append(True, np.diff(key[order]) != 0)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(new) - 1
            u, w, c = u[order][new], w[order][new], np.bincount(rank, c).astype(np.int64)
            edge = np.cumsum([0, *(len(x[0]) for x in cols)])
            asked = [squeeze(steps(rank[i:j])) for i, j in zip(edge[:-1], edge[1:], strict=True)]
            words, of = np.unique(w, return_inverse=True)
            place = save(folder, f"bucket-{bucket:06d}", _pack_pairs(u, w, c), squeeze(steps(words)), squeeze(of), "\n".join(r[1] for r in rows).encode(), *asked)
            warm = np.flatnonzero(np.isin(own, hot_words))
            at = np.searchsorted(own, u)
            hot = squeeze(own[warm], np.bincount(at, c)[warm].astype(np.int64), np.bincount(at, c > 0)[warm].astype(np.int64))
            yield table(out, [(bucket, place, int((c == 1).sum()), int((c == 2).sum()), hot, None)])

    return materialise(asked.repartition(n, "target").sortWithinPartitions("target", "chunk").mapInArrow(run, _BUCKET), "buckets")


class Margins:
    """Root customers of every word: buckets give the tables of theirs, ranges of words add them up and answer."""

    def __init__(self, types: int, parts: int, n: int, scale: int):
        self.types, self.parts, self.n, self.scale = max(types, 1), parts, n, scale

    def deal(self, bucket: int, place: str, words: np.ndarray, tables: np.ndarray) -> list[tuple]:
        edge = np.searchsorted(words * self.parts // self.types, np.arange(self.parts + 1)).tolist()
        return [(k, bucket, place, squeeze(steps(words[i:j]), tables[i:j])) for k, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if i < j]

    def add_up(self, dealt: DataFrame) -> tuple[DataFrame, tuple[int, int, int, int]]:
        """(answers by bucket, (customers, words, words with one, words with two)); tables are counted `scale` times."""
        answer = _schema("bucket long, place string, part long, blob binary, customers long, known long, ones long, twos long")
        scale = self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, rows in groups(batches):
                cols = [unsqueeze(r[2]) for r in rows]
                words = [np.cumsum(x[0].astype(np.int64)) for x in cols]
                least = min(int(x[0]) for x in words)
                total = np.bincount(np.concatenate(words) - least, np.concatenate([x[1] for x in cols])).astype(np.int64)
                yield table(answer, [(r[0], r[1], part, squeeze(total[x - least]), None, None, None, None) for r, x in zip(rows, words, strict=True)])
                yield table(answer, [(None, None, part, None, int(total.sum()), int((total > 0).sum()), int((total == scale).sum()), int((total == 2 * scale).sum()))])

        ddl = "bucket long, place string, part long, blob binary, customers long, known long, ones long, twos long"
        met = materialise(dealt.repartition(self.n, "target").sortWithinPartitions("target", "bucket").mapInArrow(run, ddl), "margins")
        size = met.where("bucket IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("customers", "known", "ones", "twos"))).first()
        return met.where("bucket IS NOT NULL").select("bucket", "part", "place", "blob"), tuple(size)


def first_margins(buckets: DataFrame, margins: Margins) -> DataFrame:
    """One table for each pair, to begin with."""
    schema = _schema(_MARGIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, place in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pairs, words, of = load(place, 0, 1, 2)
                yield table(schema, margins.deal(bucket, place, np.cumsum(unsqueeze(words)[0].astype(np.int64)), np.bincount(unsqueeze(of)[0].astype(np.int64), _unpack_pairs(pairs)[2] > 0).astype(np.int64)))

    return buckets.select("bucket", "place").mapInArrow(run, _MARGIN)


def root_of(customers: np.ndarray, size: tuple[int, int, int, int], scale: int) -> tuple[np.ndarray, float]:
    """The root's predictive probabilities of words with so many customers, and its share of all other words."""
    total, known, ones, twos = size
    d = discount_of(ones, twos)
    rest = (ROOT_STRENGTH + d * known) / (ROOT_STRENGTH + total / scale)
    c = customers / scale
    return np.where(c > 0, (c - d) / (ROOT_STRENGTH + total / scale), rest), rest


_SEATED = "bucket long, place string, blob binary, hot binary, tables binary"


def seat_buckets(answers: DataFrame, n: int, size: tuple[int, int, int, int], scale: int, discount: float, hot: dict[int, tuple[int, float]], samples: int) -> DataFrame:
    """Tables of every pair of a bucket over the samples (blob), of its words (tables) and of its part of hot contexts."""
    out = _schema(_SEATED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in groups(batches):
            place = rows[0][1]
            pairs, of = load(place, 0, 2)
            (u, w, c), of = _unpack_pairs(pairs), unsqueeze(of)[0].astype(np.int64)
            root, _ = root_of(np.concatenate([unsqueeze(r[2])[0] for r in rows]).astype(np.int64), size, scale)
            here = np.flatnonzero(c > 0)
            own, at = np.unique(u[here], return_inverse=True)
            elsewhere = np.array([round(hot[x][1]) if x in hot else 0 for x in own.tolist()], np.int64)
            part = np.array([x in hot for x in own.tolist()], bool)
            elsewhere = np.where(part, np.maximum(elsewhere - np.bincount(at, minlength=len(own)), 0), 0)
            with np.errstate(over="ignore"):
                seed = mix(mix(u[here].astype(np.uint64) + _GOLD) + w[here].astype(np.uint64) * _GOLD)
            t = np.zeros(len(u), np.int64)
            t[here] = sample_tables(c[here], at, root[of[here]], elsewhere, seed, STRENGTH, discount, BURN_IN, samples)
            warm = squeeze(own[part], np.bincount(at, t[here], len(own))[part].astype(np.int64))
            yield table(out, [(bucket, place, squeeze(t), warm, squeeze(np.bincount(of, t).astype(np.int64)))])

    return materialise(answers.repartition(n, "bucket").sortWithinPartitions("bucket", "part").mapInArrow(run, _SEATED), "seated")


def later_margins(seated: DataFrame, margins: Margins) -> DataFrame:
    schema = _schema(_MARGIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, place, tables in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words = np.cumsum(unsqueeze(load(place, 1)[0])[0].astype(np.int64))
                yield table(schema, margins.deal(bucket, place, words, unsqueeze(tables)[0].astype(np.int64)))

    return seated.select("bucket", "place", "tables").mapInArrow(run, _MARGIN)


_ANSWER = "chunk string, bucket long, place string, blob binary"


def answer_pairs(answers: DataFrame, seated: DataFrame, n: int, size: tuple[int, int, int, int], scale: int, discount: float, hot: dict[int, tuple[int, float]], samples: int) -> DataFrame:
    """For every chunk the log10 probabilities of the pairs it asked each bucket for."""
    out = _schema(_ANSWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in groups(batches):
            place, seats = rows[0][1], rows[0][2]
            pairs, of, chunks = load(place, 0, 2, 3)
            (u, w, c), of = _unpack_pairs(pairs), unsqueeze(of)[0].astype(np.int64)
            root, _ = root_of(np.concatenate([unsqueeze(r[2])[0] for r in rows[1:]]).astype(np.int64), size, scale)
            t = unsqueeze(seats)[0].astype(np.int64) / samples
            own, at = np.unique(u, return_inverse=True)
            customers, tables = np.bincount(at, c), np.bincount(at, t)
            for k, x in enumerate(own.tolist()):
                if x in hot:
                    customers[k], tables[k] = hot[x]
            p = (c - discount * t) / (STRENGTH + customers)[at] + ((STRENGTH + discount * tables) / (STRENGTH + customers))[at] * root[of]
            log = np.log10(np.minimum(p, 1.0)).astype("<f4")
            names = chunks.decode().split("\n")
            for chunk, asked in zip(names, load(place, *range(4, 4 + len(names))), strict=True):
                yield table(out, [(chunk, bucket, None, squeeze(log[np.cumsum(unsqueeze(asked)[0].astype(np.int64))]))])

    rows = answers.unionByName(seated.select("bucket", F.lit(-1).cast("long").alias("part"), "place", "blob"))
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "part").mapInArrow(run, _ANSWER)


_SCORED = "doc_id long, learns boolean, n_tokens long, n_known long, base_score double, score double"


def add_up(answers: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """The scores of the documents of all chunks."""
    out = _schema(_SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches):
            place = next(r[1] for r in rows if r[0] < 0)
            log = np.concatenate([unsqueeze(r[2])[0] for r in rows if r[0] >= 0]).astype(float)
            gap, head, base = load(place, 0, 1, 2)
            size, train, known, ids, n_known = unsqueeze(head)
            # steps are back to front at a document's first pair only, so sums from there give the pairs' places
            total = np.cumsum(unsqueeze(gap)[0].astype(np.int64))
            begins = np.cumsum(size) - size
            first = unsqueeze(gap)[0].astype(np.int64)[begins]
            pair = total - np.repeat(total[begins] - first, size)
            score = np.bincount(np.repeat(np.arange(len(size)), size), log[pair], len(size))
            doc = pa.array(ids.astype(np.uint64).view(np.int64), pa.int64(), mask=known == 0)
            cols = [doc, pa.array(train.astype(bool)), pa.array(size.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(unsqueeze(base)[0].astype(float)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, schema=out)

    rows = answers.unionByName(chunks.select("chunk", F.lit(-1).cast("long").alias("bucket"), "place", F.lit(None).cast("binary").alias("blob")))
    return rows.repartition(n, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, _SCORED)


def score(docs: DataFrame, learns: Column, rounds: int = 2, samples: int = SAMPLES, chunk_tokens: int = 3_000_000, bucket_tokens: int = 2_000_000) -> DataFrame:
    """Learn from the rows of docs (doc_id, text) for which learns holds, score all of them.

    Returns doc_id, learns, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity, of every row.
    """
    spark, mark = docs.sparkSession, set(written())
    n, folder = spread(docs), new_folder(docs.sparkSession, "pairs")
    src = docs.select("doc_id", "text", F.coalesce(learns, F.lit(False)).alias("learns"))
    chunks = write_chunks(src, folder, chunk_tokens)
    tokens, train_docs = (x or 0 for x in chunks.agg(F.sum("tokens"), F.sum("docs")).first())
    buckets = max(1, -(-tokens // bucket_tokens))
    numbered = number_words(chunks, n, n, tokens, buckets)
    sizes = {r["part"]: r for r in numbered.where("chunk IS NULL").select("part", "types", "known", "hot").collect()}  # a row per range
    offset, types, kinds, hot_words = [], 0, 0, {}
    for k in range(n):
        offset.append(types)
        if k in sizes:
            at, count = unsqueeze(sizes[k]["hot"])
            hot_words |= dict(zip((at.astype(np.int64) + types + 1).tolist(), count.tolist(), strict=True))
            types, kinds = types + sizes[k]["types"], kinds + sizes[k]["known"]
    if train_docs * buckets > tokens:
        hot_words[0] = train_docs
    asked = ask_pairs(numbered, chunks, folder, offset, n, tokens, train_docs, kinds, buckets)
    opened = open_buckets(asked, folder, n, np.array(sorted(hot_words), np.int64))
    files = opened.where("bucket IS NOT NULL")
    ones, twos = (x or 0 for x in files.agg(F.sum("ones"), F.sum("twos")).first())
    discount = discount_of(ones, twos)

    def hot_tables(parts: DataFrame, column: int, scale: int) -> dict[int, tuple[int, float]]:
        """Customers and tables of the hot contexts, over all buckets; fewer contexts than buckets."""
        total = dict.fromkeys(hot_words, 0.0)
        for r in parts.select("hot").toLocalIterator():
            own, *values = unsqueeze(r["hot"])
            for x, v in zip(own.tolist(), values[column].tolist(), strict=True):
                total[x] += v / scale
        return {x: (hot_words[x], t) for x, t in total.items()}

    hot = hot_tables(files, 1, 1) if hot_words else {}
    margins = Margins(types, n, n, 1)
    answers, size = margins.add_up(first_margins(files, margins))
    seated = None
    for _ in range(rounds):
        seated = seat_buckets(answers, n, size, margins.scale, discount, hot, samples)
        margins = Margins(types, n, n, samples)
        hot = hot_tables(seated, 0, samples) if hot_words else {}
        answers, size = margins.add_up(later_margins(seated, margins))
    places = opened.where("bucket IS NULL").select("chunk", "place")
    done = add_up(answer_pairs(answers, seated.select("bucket", "place", "blob"), n, size, samples, discount, hot, samples), places, n)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    rows = materialise(done.select("doc_id", "learns", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity")), "scores")
    drop_written(spark, keep=mark | {p for p in written() if "/scores-" in p})
    return rows


def held_out_scores(docs: DataFrame, **options: int) -> DataFrame:
    """Learn from the documents whose crc32 remainder of 7 is not 2, score all of them."""
    out = score(doc_texts(docs), remainder("doc_id", 7) != 2, **options)
    return out.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
