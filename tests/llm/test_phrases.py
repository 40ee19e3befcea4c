import random
import re
from collections import Counter

import numpy as np

from sphaera.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least=10, cover=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in cand.items():
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                longer[lang, part] = max(longer[lang, part], a)
    out = {}
    for (lang, w), a in cand.items():
        if len(w) == 2 and longer[lang, w] and 100 * longer[lang, w] >= cover * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def made(seed, n=400):
    random.seed(seed)
    words = ["Of", "the", "of", "new", "york", "city", "a\x01", "a", "é", "漢", "x\x1cy", "<b>", "\x00"]
    rows = []
    for _ in range(n):
        text = "".join(random.choice(words) + random.choice([" ", " ", "  ", "\t", ". ", "\n", " ,", "\r\n", "; new york city ", " of the "]) for _ in range(random.randint(0, 25)))
        rows.append((random.choice(["en", "de", None, "und", ""]), random.choice([text, text, text, None])))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, "c", 1) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, word string, shard int").repartition(6)


def result(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def test_equals_brute_force(spark):
    rows = made(1)
    for size, least, cover, top in ((1 << 24, 10, 50, 2000), (400, 10, 50, 25), (60, 2, 90, 2000)):
        assert result(phrases.mine(table(spark, rows), least, cover, top, size)) == by_hand(rows, least, cover, top)


def test_scores_beyond_64_bits(spark):
    rows = [(10**15, 2 * 10**15, 3 * 10**15), (10**16 - 1, 10**16 - 1, 10**16 - 1), (10, 10**16 - 1, 10), (7, 11, 13)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    assert [r[0] for r in df.select(phrases._score("l", "r")).collect()] == [1_000_000 * a * a // (x * y) for a, x, y in rows]


def test_lists():
    words, sizes, lists = phrases.shard_lists(["a b A", "", "b,b  a\tc"])
    at = dict(zip(words, np.split(lists, np.cumsum(sizes)[:-1]), strict=True))
    assert {w: len(v) for w, v in at.items()} == {b"a": 3, b"b": 3, b"c": 1} and list(at[b"a"][:2]) == [0, 2] and at[b"b"][0] == 1
    assert np.array_equal(phrases._unpack(phrases._pack(lists)), lists) and len(phrases._unpack(phrases._pack(lists[:0]))) == 0
    assert phrases.shard_lists([""])[0] == []


def test_odd_and_empty(spark, odd, empty):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert result(phrases.mine(odd)) == by_hand(rows)
    assert phrases.mine(empty).collect() == []
    assert phrases.mine(odd.where("doc_id = 2")).collect() == []


def test_packed_rows():
    rng = np.random.default_rng(3)
    columns = [np.sort(rng.integers(0, 1 << 60, 999)), rng.integers(-(1 << 62), 1 << 62, 999), np.ones(999, np.int64)]
    for n in (999, 1, 0):
        assert all(np.array_equal(x, c[:n]) for x, c in zip(phrases._unpacked(phrases._packed(*(c[:n] for c in columns)), 3), columns, strict=True))


def test_pairs_of_a_shard_travel_packed(spark):
    """Bytes of the pairs' counts for each pair of a shard: a row with four numbers takes 32 before compression."""
    rng = np.random.default_rng(5)
    words = 1 << 33 | np.arange(3000, dtype=np.int64)
    pairs = np.unique(rng.integers(0, 9_000_000, 300_000))
    dealt = list(phrases._dealt(20, [words[pairs // 3000], words[pairs % 3000]], rng.integers(1, 4, len(pairs))))
    assert sorted(p for p, _ in dealt) == list(range(20)) and sum(len(x) for _, x in dealt) < 5 * len(pairs)
    back = [_ for _, x in dealt for _ in zip(*(c.tolist() for c in phrases._unpacked(x, 3)[:2]), strict=True)]
    assert len(back) == len(pairs) == len(set(back))
