"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents with a confirmed toxic label, unlabelled text is a sample of all documents of the training side,
whatever their label.  A linear model over subword features is fitted in numpy with the non-negative risk estimator

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)),

whose class prior is the toxic share among the labelled rows of the training side.  Its margin is mapped to a score by
a logistic curve fitted on those labelled rows.

Features of a document are summed over its distinct lower-cased words: the word itself and its character n-grams with
marked borders.  Selection keeps the features that are significantly more frequent in the positives.  The training sample is bounded
(max_positive, max_unlabelled, chosen by a hash of the id); scoring covers every document and whole texts.

max_unlabelled is the size of the unlabelled sample of the estimator; labels are used as far as max_positive goes, and
those of sampled documents.  A feature counts at most MOST_HITS words of a document; a word of more than 30 bytes has no
feature of its own, but all its n-grams.

Null texts are empty; texts without a word get the score of an empty margin.  Without any usable label the score is the
prior 0.0 for all.  Repeated rows get equal scores.  Label rows with a null id, a null label or no document are ignored;
of contradicting labels the toxic one counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.llm.common import doc_texts, remainder

NGRAMS = (4, 5, 6)
CACHED_WORDS = 200_000
#: Words of a document that count for one feature.
MOST_HITS = 3


def word_features(word: bytes) -> list[bytes]:
    marked = b"^" + word + b"$"
    out = [marked] if len(marked) <= 32 else []
    for n in NGRAMS:
        out += [marked[i : i + n] for i in range(len(marked) - n + 1)]
    return list(dict.fromkeys(out))


def distinct_words(raw: bytes) -> set[bytes]:
    return set(raw.lower().translate(_LETTERS).split())


#: ASCII characters that are neither letters nor digits part words.
_LETTERS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[bytes, float]
    bias: float
    slope: float
    offset: float
    prior: float

    def scorer(self) -> Callable[[bytes], float]:
        """A function from a text's bytes to its margin; it remembers the features of the words it has met."""
        place = {f: i for i, f in enumerate(self.weights)}
        weight = np.array(list(self.weights.values()))
        known: dict[bytes, tuple[int, ...]] = {}

        def margin(raw: bytes) -> float:
            if len(known) > CACHED_WORDS:
                known.clear()
            hits: list[int] = []
            for w in distinct_words(raw):
                found = known.get(w)
                if found is None:
                    found = known[w] = tuple(place[f] for f in word_features(w) if f in place)
                if found:
                    hits += found
            return self.bias + (float(np.minimum(np.bincount(hits, minlength=len(weight)), MOST_HITS) @ weight) if hits else 0.0)

        return margin

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with the logistic loss; p and u are matrices of small counts.

    Equal rows and equal columns are fitted once, with their number as weight: most rows have no feature at all.
    """
    columns, place = np.unique(np.vstack([p, u]).T, axis=0, return_inverse=True)
    place = place.ravel()
    p, u = columns[:, : len(p)].T, columns[:, len(p) :].T
    (p, np_), (u, nu) = (np.unique(x, axis=0, return_counts=True) for x in (p, u))
    wp, wu = (np_ / np_.sum()).astype(np.float32), (nu / nu.sum()).astype(np.float32)
    theta = np.zeros(p.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    p1, u1 = (np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32) for x in (p, u))
    softplus = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        now = theta.astype(np.float32)
        zp, zu = p1 @ now, u1 @ now
        sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
        negative = softplus(zu) @ wu - prior * (softplus(zp) @ wp)
        g_pos = -prior * ((wp * (1 - sp)) @ p1)
        g_neg = (wu * su) @ u1 - prior * ((wp * sp) @ p1)
        g = g_pos + g_neg if negative >= 0 else -g_neg
        g = g + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return (theta[:-1] / np.bincount(place, minlength=len(columns)))[place], float(theta[-1])


def fit_logistic(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Platt scaling by Newton steps, with its usual smoothed targets; a positive counts twice, as labels miss some."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, weight = np.stack([z, np.ones_like(z)], 1), np.where(y > 0, 2.0, 1.0)
    b = np.array([1.0, 0.0])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (target - q)) - 1e-3 * b)
        b = b + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def hashed_sample(ids: DataFrame, most: int) -> DataFrame:
    """The rows of least hash of doc_id, `most` at most.

    A share of the hashes that holds about twice as many rows is cut out first, so the sort sees few rows of each task.
    """
    n = ids.count()
    key = F.xxhash64(F.col("doc_id"), F.lit(17))
    if n > 4 * most:
        ids = ids.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(18)), F.lit(1 << 30)) < int(2 * most / n * (1 << 30)))
    return ids.orderBy(key, "doc_id").limit(most)


def training_sample(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> DataFrame:
    """(doc_id, text, toxic 1/0/null): the bounded sample of the training side."""
    on_side = remainder("doc_id", 3) != 1
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & on_side)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    positive = hashed_sample(known.where("toxic = 1"), max_positive)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & on_side)
    unlabelled = hashed_sample(ids, max_unlabelled).distinct().join(known, "doc_id", "left")
    chosen = positive.union(unlabelled.select("doc_id", "toxic")).distinct()
    return doc_texts(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 8000, n_features: int = 1500, min_evidence: float = 30.0) -> ToxicityModel:
    sample = training_sample(docs, labels, max_positive, max_unlabelled)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of each feature over the words of the positive and of the other rows of one partition."""
        seen = {1: Counter(), 0: Counter()}
        for b in batches:
            for raw, y in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                own: set[bytes] = set()
                for w in distinct_words(raw):
                    own.update(word_features(w))
                seen[int(y == 1)].update(own)
        keys = list(seen[1] | seen[0])
        for k in range(0, len(keys), 20_000):
            part = keys[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[1][f] for f in part], pa.int64()), pa.array([seen[0][f] for f in part], pa.int64())], names=["feature", "n_pos", "n_other"])

    n_pos = F.sum("n_pos").alias("n_pos")
    sample = sample.repartition(max(2, sample.sparkSession.sparkContext.defaultParallelism), "doc_id").persist()
    size = sample.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n"), F.count(F.lit(1)).alias("all")).first()
    if not size["p"] or size["all"] == size["p"]:
        sample.unpersist()
        return ToxicityModel({}, 0.0, 1.0, -40.0, 0.0)
    # twice the log-likelihood ratio of the feature's share of positives against that of the sample
    base = size["p"] / size["all"]
    n, hit = F.col("n_pos") + F.col("n_other"), F.col("n_pos") / (F.col("n_pos") + F.col("n_other"))
    part = lambda q, b: F.when(q > 0, q * F.log(q / F.lit(b))).otherwise(0.0)
    evidence = 2 * n * (part(hit, base) + part(1 - hit, 1 - base))
    best = (
        sample.mapInArrow(features, "feature binary, n_pos long, n_other long").groupBy("feature").agg(n_pos, F.sum("n_other").alias("n_other"))
        .where(hit > base).withColumn("evidence", evidence).where(F.col("evidence") >= min_evidence).orderBy(F.desc("evidence"), "feature").limit(n_features).collect()
    )
    names = [bytes(r["feature"]) for r in best]
    if not names:
        sample.unpersist()
        return ToxicityModel({}, float(np.log(base / (1 - base))), 1.0, 0.0, base)
    place = {f: i for i, f in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                hits = Counter(place[f] for w in distinct_words(raw) for f in word_features(w) if f in place)
                found.append([x for kv in hits.items() for x in kv])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "hits"])

    table = sample.mapInArrow(rows, "doc_id long, toxic int, hits array<int>").orderBy("doc_id").toArrow()  # bounded by the sample
    sample.unpersist()
    x = np.zeros((table.num_rows, len(names)), np.uint8)
    at = 0
    for chunk in table["hits"].chunks:
        pairs, ends = chunk.flatten().to_numpy(), np.diff(chunk.offsets.to_numpy())
        of = at + np.repeat(np.arange(len(chunk)), ends // 2)
        x[of, pairs[::2]] = np.minimum(pairs[1::2], MOST_HITS)
        at += len(chunk)
    labels_of = table["toxic"].to_pylist()
    del table
    toxic = np.array([-1 if y is None else y for y in labels_of])
    # the prior is that of labelled rows drawn like the unlabelled sample
    drawn = toxic >= 0
    known = labels.where(remainder(F.col("doc_id").cast("long"), 3) != 1).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = float(np.clip(known if known is not None else toxic[drawn].clip(0).mean(), 0.005, 0.9))
    # the unlabelled side stands for all text: positives beyond their natural share are left out of it
    unlabelled = toxic != 1
    share = int(round(unlabelled.sum() * prior / (1 - prior)))
    u = np.vstack([x[unlabelled], x[toxic == 1][:share]])
    w, bias = fit_nnpu(x[toxic == 1], u, prior)
    labelled = toxic >= 0
    z = np.concatenate([part @ w for part in np.array_split(x[labelled], 16)]) + bias
    slope, offset = fit_logistic(z.astype(float), toxic[labelled].astype(float)) if (toxic == 0).any() else (1.0, 0.0)
    if slope <= 0:
        slope, offset = 1.0, 0.0
    return ToxicityModel(dict(zip(names, map(float, w), strict=True)), bias, slope, offset, prior)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """doc_id and score in [0, 1] for every row of docs, whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        margin = m.scorer()
        for b in batches:
            z = np.array([margin(raw) for raw in b.column(1).cast(pa.binary()).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(z))], names=["doc_id", "score"])

    return doc_texts(docs, text_col=text_col).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds: int) -> DataFrame:
    """The rows of docs whose score is below threshold, all columns kept.  Rows are scored in place, without a join."""
    model = fit(docs, labels, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        margin = m.scorer()
        for b in batches:
            z = np.array([margin(raw or b"") for raw in b.column(at).cast(pa.binary()).to_pylist()], float)
            yield b.filter(pa.array(m.score(z) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
