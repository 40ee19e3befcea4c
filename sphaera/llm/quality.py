"""Quality rules by distribution divergence.

Every document gets two histograms, one of character classes and one of common words (all other words share the last
bin).  References per language are learned from the corpus itself: every document that passes the base rules and is long
enough adds its histograms, weighted alike, to its language's mean.  The half that lies nearest to it gives a second mean,
and the reference is the mean of all documents that are not far from that one, so odd documents do not shift it.  A label has a reference only if LEAST_DOCS documents or more are in it and most of its characters are
letters, so a stray label, a label per document or a label of junk has none.

The verdict takes the Jensen-Shannon distance (square root of the divergence, base 2) to the nearest of a text's own
language, the text itself left out of it, and of the languages that anyone may be written in: those with a 64th or more of
all documents and some common words, 64 at most whatever the corpus.  So a wrong label costs a text nothing, and an odd
label wins it nothing.  Of two equally near references the own language's counts, then the one with more documents; the
verdict is the same.  Own references are joined by label, as a table.

Words are runs of bytes other than space, tab, \\n, \\v, \\f, \\r.  Null texts are empty: all counts 0, base_failed.
Documents below min_words get no divergence verdict (the base rules decide).  Repeated rows are judged one by one.
With an empty table, or no document fit for a reference, no document is failed by divergence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphaera.llm.common import KEEP, materialise

# Frequent function words of four languages.
COMMON_WORDS = (
    "the of and to in is that it for was on are as with his they at be this from or had by but not what were we when"
    " der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat"
    " de la le les et un une du que qui dans en des pour est pas au sur plus par ce il avec"
    " el los las y del se por con para una su al lo como más o pero sus"
).split()
COMMON_WORDS = tuple(dict.fromkeys(COMMON_WORDS))

CHAR_CLASSES = ("lower", "upper", "digit", "space", "newline", "sentence_mark", "other_mark", "symbol", "control", "wide")


def _class_of_byte() -> np.ndarray:
    """Class number of every byte; continuation bytes are no characters (-1), lead bytes stand for one wide character."""
    out = np.full(256, CHAR_CLASSES.index("other_mark"), np.int64)
    put = lambda name, chars: out.__setitem__(list(chars), CHAR_CLASSES.index(name))
    put("control", range(0, 32))
    put("control", [127])
    put("lower", range(97, 123))
    put("upper", range(65, 91))
    put("digit", range(48, 58))
    put("space", b" \t\x0b\x0c")
    put("newline", b"\n\r")
    put("sentence_mark", b".,;:!?'\"-()")
    put("symbol", b"#*$%&|<>")
    out[128:192] = -1
    put("wide", range(192, 256))
    return out


BYTE_CLASS = _class_of_byte()
LANGUAGES = 64
#: Documents of one label are dealt to so many places where they meet what is known of it.
SALTS = 64
LEAST_DOCS, LEAST_LETTERS, LEAST_COMMON = 16, 0.5, 0.05
_LETTERS = [CHAR_CLASSES.index(x) for x in ("lower", "upper", "wide")]
N_CLASSES, N_WORDS = len(CHAR_CLASSES), len(COMMON_WORDS) + 1
_MIX = np.uint64(0x9E3779B97F4A7C15)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words inside a window of width words that is found twice or more; all occurrences count."""
    n = len(hashes)
    if n <= width:
        return 0
    h = hashes[: n - width + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            h *= _MIX
            h ^= h >> np.uint64(29)
            h += hashes[k : n - width + 1 + k]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + width] -= 1
    return int((np.cumsum(edge[:n]) > 0).sum())


def document_counts(raw: bytes, common: dict[bytes, int]) -> tuple[int, int, int, int, int, np.ndarray, np.ndarray]:
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = np.bincount(BYTE_CLASS[BYTE_CLASS >= 0], by_byte[BYTE_CLASS >= 0], N_CLASSES).astype(np.int64)
    words = raw.split()
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ids = [i for w in words if (i := common.get(w)) is not None]
    histogram = np.bincount(ids, minlength=N_WORDS).astype(np.int64) if ids else np.zeros(N_WORDS, np.int64)
    histogram[-1] = len(words) - len(ids)
    word_chars = int(by_byte.sum() - by_byte[128:192].sum() - by_byte[[32, 9, 10, 11, 12, 13]].sum())
    symbols = int(by_byte[list(b"#*$%&|<>")].sum())
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(hashes), chars, histogram


def _common_bytes() -> dict[bytes, int]:
    out = {}
    for i, w in enumerate(COMMON_WORDS):
        out[w.encode()] = i
        out[w.capitalize().encode()] = i
    return out


def profiles(docs: DataFrame, lang_col: str | None = "lang") -> DataFrame:
    """doc_id, lang, the base counts and the two histograms of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = _common_bytes()
        for b in batches:
            rows = [document_counts(t, common) for t in b.column(2).cast(pa.binary()).to_pylist()]
            ints = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            packed = pa.array([zlib.compress(np.concatenate(r[5:]).astype("<u4").tobytes(), 1) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *ints, packed], names=["doc_id", "lang", *BASE, "histograms"]).select(["doc_id", *BASE, "lang", "histograms"])

    lang = F.lower(F.trim(F.col(lang_col).cast("string"))) if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, COUNTS + ", lang string, histograms binary").select("doc_id", "lang", *BASE, "histograms")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _shares(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    both = np.array([np.frombuffer(zlib.decompress(x), "<u4") for x in b.column("histograms").to_pylist()], float).reshape(b.num_rows, N_CLASSES + N_WORDS)
    c, w = both[:, :N_CLASSES], both[:, N_CLASSES:]
    return c / np.maximum(c.sum(1, keepdims=True), 1), w / np.maximum(w.sum(1, keepdims=True), 1)


SUMS = "lang string, n long, sums array<double>"


def _sum_up(rows: DataFrame, parts) -> DataFrame:
    """lang, n, sums of what `parts` gives for every batch."""
    bins = N_CLASSES + N_WORDS
    held = rows.mapInArrow(parts, SUMS).groupBy("lang").agg(F.sum("n").alias("n"), *(F.sum(F.element_at("sums", i + 1)).alias(f"s{i}") for i in range(bins)))
    return held.select("lang", "n", F.array(*(f"s{i}" for i in range(bins))).alias("sums"))


def _sums(langs: list[str], c: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    names, at = np.unique(np.array(langs, dtype=str), return_inverse=True)
    sums = np.zeros((len(names), N_CLASSES + N_WORDS))
    np.add.at(sums, at, np.hstack([c, w]))
    return pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(np.bincount(at, minlength=len(names))), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["lang", "n", "sums"])


def _by_label(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """rows (doc_id, lang) with the columns of a row per label; a common label meets its row in SALTS places."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    return salted.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["lang", "_salt"], how).drop("_salt")


def _near(c: np.ndarray, w: np.ndarray, mean: np.ndarray, n_words: np.ndarray, limits: tuple[float, float, float, float]) -> np.ndarray:
    """Whether rows lie within the limits of a mean; both may be a row each."""
    root = np.sqrt(np.maximum(n_words, 1))
    return (js_distance(c, mean[..., :N_CLASSES]) <= limits[0] + limits[2] / root) & (js_distance(w, mean[..., N_CLASSES:]) <= limits[1] + limits[3] / root)


def _fit(min_words: int) -> Column:
    return ~base_failed() & (F.col("n_words") >= min_words)


def references(profiled: DataFrame, min_words: int, limits: tuple[float, float, float, float], least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, n, sums (of both histograms, over the n documents that are not far from the first mean), first (that mean)."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _sums(b.column("lang").to_pylist(), *_shares(b))

    def near_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c, w = _shares(b)
                keep = _near(c, w, _rows_of(b, "first"), b.column("n_words").to_numpy(), limits)
                yield _sums([x for x, k in zip(b.column("lang").to_pylist(), keep, strict=True) if k], c[keep], w[keep])

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                (c, w), m = _shares(b), _rows_of(b, "mean")
                d = js_distance(c, m[:, :N_CLASSES]) + js_distance(w, m[:, N_CLASSES:])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("histograms"), pa.array(d)], names=["doc_id", "lang", "histograms", "d"])

    fit = profiled.where(_fit(min_words)).select("doc_id", "lang", "n_words", "histograms")
    mean = lambda sums, name: sums.select("lang", F.transform("sums", lambda x: x / F.col("n")).alias(name))
    every = mean(_sum_up(fit, all_of).where(F.col("n") >= least_docs), "mean")
    apart = _by_label(fit, every).mapInArrow(distances, "doc_id long, lang string, histograms binary, d double")
    half = _by_label(apart, apart.groupBy("lang").agg(F.percentile_approx("d", 0.5, 10_000).alias("middle"))).where(F.col("d") <= F.col("middle")).select("lang", "histograms")
    first = materialise(mean(_sum_up(half, all_of), "first"), "first-references")
    second = _sum_up(_by_label(fit, first), near_ones)
    letters = sum((F.element_at("sums", i + 1) for i in _LETTERS), F.lit(0.0)) / F.col("n")
    return materialise(second.where((F.col("n") >= least_docs) & (letters >= LEAST_LETTERS)).join(first, "lang"), "references")


def _rows_of(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, N_CLASSES + N_WORDS)


def _candidates(refs: DataFrame, all_docs: int) -> list[tuple[str, np.ndarray]]:
    """Name and mean of the languages that any text may be compared with: LANGUAGES at most, as each has that share of all."""
    common = 1 - F.element_at("sums", N_CLASSES + N_WORDS) / F.col("n")
    chosen = refs.where((F.col("n") * LANGUAGES >= all_docs) & (common >= LEAST_COMMON)).orderBy(F.desc("n"), "lang").collect()  # LANGUAGES rows
    return [(r["lang"], np.array(r["sums"]) / r["n"]) for r in chosen]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q, base 2, in [0, 1]."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def score(docs: DataFrame, lang_col: str | None = "lang", min_words: int = 20, max_char_distance: float = 0.2, max_word_distance: float = 0.2, odd_char_distance: float = 0.118, char_slack: float = 0.9, word_slack: float = 0.7) -> DataFrame:
    """Base counts, distances to the nearest reference and the verdict for every row of docs.

    A short text's histogram strays from its reference by chance, in proportion to 1 / sqrt(words).  As the length guard
    the limits are max_char_distance + char_slack / sqrt(n_words) and max_word_distance + word_slack / sqrt(n_words).
    A document fails beyond the first, or beyond the second if its characters are odd too (over odd_char_distance):
    a text that mixes languages has few words of any one list, but usual characters.
    """
    limits = (max_char_distance, max_word_distance, char_slack, word_slack)
    profiled = profiles(docs, lang_col).persist(KEEP)
    refs = references(profiled, min_words, limits)
    candidates = _candidates(refs, profiled.where(_fit(min_words)).count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, (c, w) = b.num_rows, _shares(b)
            dc, dw = np.full(n, np.inf), np.full(n, np.inf)
            own = np.flatnonzero(~b.column("sums").is_null().to_numpy(zero_copy_only=False))
            if len(own):
                part = b.take(pa.array(own))
                sums, docs_in, both = _rows_of(part, "sums"), part.column("n").to_numpy().astype(float), np.hstack([c[own], w[own]])
                # a document that is part of its reference is taken out of it
                inside = part.column("fit").to_numpy(zero_copy_only=False) & _near(c[own], w[own], _rows_of(part, "first"), part.column("n_words").to_numpy(), limits)
                left = np.where(inside, docs_in - 1, docs_in)[:, None]
                ref = np.maximum(sums - both * inside[:, None], 0) / left
                dc[own], dw[own] = js_distance(c[own], ref[:, :N_CLASSES]), js_distance(w[own], ref[:, N_CLASSES:])
            langs = np.array(b.column("lang").to_pylist(), dtype=str)
            for lang, ref in candidates:
                rc, rw = js_distance(c, ref[:N_CLASSES]), js_distance(w, ref[N_CLASSES:])
                near = (rc + rw < dc + dw) & (langs != lang)
                dc, dw = np.where(near, rc, dc), np.where(near, rw, dw)
            dc, dw = np.where(np.isinf(dc), 0, dc), np.where(np.isinf(dw), 0, dw)  # no reference at all
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", *BASE)), pa.array(dc), pa.array(dw)], names=["doc_id", *BASE, "char_distance", "word_distance"])

    judged = _by_label(profiled.withColumn("fit", _fit(min_words)), refs, "left").mapInArrow(run, COUNTS + ", char_distance double, word_distance double")
    root = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    far = (F.col("n_words") >= min_words) & ((F.col("char_distance") > max_char_distance + char_slack / root) | ((F.col("word_distance") > max_word_distance + word_slack / root) & (F.col("char_distance") > odd_char_distance)))
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~far)
