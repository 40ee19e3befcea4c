"""Personal data by weak supervision, in column expressions only.

Four base kinds (email, ip, card, phone) are matched by pattern and rule and always stay.  Wider candidate patterns add
spans of further writings.  Six labelers vote on every candidate (+1, -1 or 0 for no opinion): shape, checksum or range,
gazetteer, cue words before, cue words after, and counter-evidence around.  The votes of the whole corpus are counted by
pattern (kinds x 3^6 rows at most), expectation-maximisation estimates each labeler's reliability and a posterior for
every pattern, and a logistic span classifier over votes, kind and length is fitted to the posteriors.  The classifier's
verdict on a candidate is again an expression.

Null texts are empty, an empty text has no spans.  Patterns are possessive and anchored at run borders, so that long runs
of one character take linear time and no stack.  Repeated rows and ids come through one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphaera.llm.common import KEEP, doc_texts
from sphaera.llm.spans import cut_out, gaps, let, located, matches, running_max

LOCAL = "A-Za-z0-9._%+-"
#: Anchors keep the leftmost start of each run, or the end of the match before it, and skip all hopeless later starts.
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(BASE_PATTERNS)
#: Wider candidates; a kind of its own per writing, reported under the name after the slash's left side.
WIDE_PATTERNS = {
    "email/spelled": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]\x20?dot\x20?[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    "phone/local": r"(?<![0-9+A-Za-z.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn/dashed": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban/plain": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip/colons": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "name/titled": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]{2,}+(?:\x20[A-Z][a-z]{2,}+)?",
}
VOTES = ("shape", "checksum", "gazetteer", "cue_before", "cue_after", "counter")

# Word lists of the labelers.
CUES = r"(?i)(?:e-?mail|mail|contact|phone|tel|call|mobile|fax|card|visa|account|iban|ssn|social|server|host|login|address|reach|kontakt|telefon|correo|courriel|adresse|name)"
COUNTERS = r"(?i)(?:version|release|order|invoice|isbn|chapter|figure|table|section|page|error|build|v)[\x20.:#]*$"
DOMAINS = (
    "com org net edu gov mil int info biz name pro dev app io ai co me tv cc xyz online site shop blog cloud"
    " de fr es uk eu it nl be at ch pl pt se no dk fi ie cz sk hu ro bg gr tr ru ua rs hr si lt lv ee lu is"
    " us ca mx br ar cl pe ve uy au nz jp cn kr in id my sg th vn ph tw hk za eg ma ng ke il ae sa ir pk"
).split()
MAIL_GAZETTEER = r"(?i)(?:\.|dot[\])]?\x20?)(?:" + "|".join(DOMAINS) + r")\b"
NAMES = (
    "Anna Maria Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Emily Laura Emma Olivia Sophia Amelia Charlotte Alice Julia Kate Helen Ruth Grace Jane"
    " James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Peter Henry Edward Oliver Jack Harry Samuel Benjamin Adam Simon Martin Alexander"
    " Hans Klaus Wolfgang Jürgen Dieter Stefan Andreas Markus Tobias Lukas Felix Jonas Karl Heinrich Ursula Monika Petra Sabine Birgit Heike Katrin Claudia Greta Lena Hannah"
    " Jean Pierre Michel Philippe Alain Nicolas Jacques François Luc Antoine Marie Nathalie Isabelle Sylvie Catherine Françoise Monique Camille Chloé Sophie Claire Élise Manon Juliette Louise"
    " José Jose Juan Antonio Manuel Francisco Luis Carlos Javier Miguel Pedro Pablo Alejandro Fernando Diego Carmen Josefa Isabel Ana Dolores Pilar Teresa Rosa Lucía Elena Marta Paula Sofía"
).split()
FIRST_NAMES = r"\b(?:" + "|".join(dict.fromkeys(NAMES)) + r")\b"
RESERVED_IP = r"^(?:0|127|255)\."


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def worth(i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def iban_check(hit: Column) -> Column:
    """Digits of the number with its first four characters last, letters as 10 to 35, leave 1 by 97."""
    plain = F.regexp_replace(hit, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.left(plain, F.lit(4))), "")

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def base_rule(kind: str, hit: Column) -> Column:
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    number = digits(hit)
    return {
        "email": F.lit(True),
        "ip": hit.rlike(rf"^{octet}(?:\.{octet}){{3}}$"),
        "card": F.when(F.length(number).between(14, 19), luhn(number)).otherwise(False),
        "phone": F.length(number).between(10, 15),
    }[kind]


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(F.coalesce(yes, F.lit(False)), 1)
    return (out.when(F.coalesce(no, F.lit(False)), -1) if no is not None else out).otherwise(0).cast("tinyint")


def votes(kind: str, s: Column) -> list[Column]:
    """The labelers' votes on a candidate span of one kind."""
    hit, before, after = s["text"], s["before"], s["after"]
    number = digits(hit)
    glued = before.rlike(r"[0-9A-Za-z_/=]$") | after.rlike(r"^[0-9A-Za-z_/=]")
    shape = {
        "email": hit.rlike(r"^[A-Za-z0-9]") & hit.rlike(r"\.[A-Za-z]{2,}$"), "ip": ~hit.rlike(r"(^|\.)0[0-9]"), "card": hit.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2,3})"), "phone": hit.rlike(r"^\+[0-9]{1,3}[\x20.(-]"),
        "email/spelled": hit.rlike(r"[A-Za-z]{2,}$"), "phone/local": hit.rlike(r"^(?:\([0-9]{3}\)\x20|[0-9]{3}([.-])[0-9]{3}\1)"), "ssn/dashed": ~hit.rlike(r"^(?:000|666|9)"), "iban/plain": hit.rlike(r"^[A-Z]{2}[0-9]{2}"), "ip/colons": F.lit(True), "name/titled": hit.rlike(r"\x20[A-Z][a-z]+\x20[A-Z]"),
    }[kind]
    checksum = {
        "email": (F.length(hit) <= 254, F.length(hit) > 254), "ip": (~hit.rlike(RESERVED_IP), hit.rlike(RESERVED_IP)), "card": (hit.rlike(r"^[3456]"), hit.rlike(r"^[0179]")), "phone": (F.length(number).between(11, 13), F.length(number) > 14),
        "phone/local": (hit.rlike(r"^\(?[2-9]"), hit.rlike(r"^\(?[01]")), "ssn/dashed": (~hit.rlike(r"-00-|-0000$"), hit.rlike(r"-00-|-0000$")), "iban/plain": (iban_check(hit), ~iban_check(hit)),
    }.get(kind, (F.lit(False), F.lit(False)))
    gazetteer = {"email": hit.rlike(MAIL_GAZETTEER), "email/spelled": hit.rlike(MAIL_GAZETTEER), "name/titled": hit.rlike(FIRST_NAMES), "iban/plain": hit.rlike(r"^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PL|PT)"), "card": hit.rlike(r"^(?:4|5[1-5]|34|37|6011)")}.get(kind, F.lit(False))
    return [_vote(shape, ~shape), _vote(*checksum), _vote(gazetteer), _vote(before.rlike(CUES + r"[^\n]{0,12}$")), _vote(after.rlike(r"^[^\n]{0,12}" + CUES)), _vote(F.lit(False), glued | before.rlike(COUNTERS))]


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda s: base_rule(kind, s["text"])


def _judged(kind: str, rank: int, spans: Column) -> Column:
    """The spans with kind, votes and length class in place of their texts."""

    def judge(s: Column) -> Column:
        size = F.least(F.length(s["text"]) / 4, F.lit(9)).cast("int").alias("size")
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), *(v.alias(n) for v, n in zip(votes(kind, s), VOTES, strict=True)), size)

    return F.transform(spans, judge)


def candidates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base (array of kind rank, start, stop) and wide (the same with the votes and a length class) per row.

    docs: doc_id, text and the columns in keep, which are passed on.
    """
    text = F.col("text")
    out = docs
    gate = {"email": text.contains("@"), "card": text.rlike("[0-9]"), "ip": text.rlike(r"[0-9]\.[0-9]"), "phone": text.rlike(r"\+[0-9]"), "email/spelled": text.rlike(r"[\[(]\x20?at\x20?[\])]"), "name/titled": text.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]{2}"), "iban/plain": text.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{8}"), "ip/colons": text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"), "phone/local": text.rlike(r"[0-9][\x20.-][0-9]{3}[\x20.-][0-9]{4}"), "ssn/dashed": text.rlike("[0-9]-[0-9]{2}-[0-9]{4}")}
    patterns = BASE_PATTERNS | WIDE_PATTERNS
    name = {k: k.replace("/", "_") for k in patterns}
    empty = F.array().cast("array<string>")
    out = out.withColumns({f"m_{name[k]}": F.when(gate[k], matches(text, p)).otherwise(empty) for k, p in patterns.items()} | {f"g_{name[k]}": F.when(gate[k], gaps(text, p)).otherwise(empty) for k, p in patterns.items()})
    out = out.select("doc_id", *keep, *(located(F.col(f"m_{n}"), F.col(f"g_{n}")).alias(f"s_{n}") for n in name.values()))
    base = [_judged(k, r, F.filter(F.col(f"s_{k}"), _passes(k))) for r, k in enumerate(KINDS)]
    wide = [_judged(k, r, F.col(f"s_{name[k]}")) for r, k in enumerate(WIDE_PATTERNS, len(KINDS))]
    out = out.select("doc_id", *keep, F.array_sort(F.concat(*base)).alias("base"), F.concat(*wide).alias("wide"))
    # a wider candidate that touches a base span adds nothing
    return out.withColumn("wide", F.when((F.size("wide") == 0) | (F.size("base") == 0), F.col("wide")).otherwise(_apart(F.col("base"), F.col("wide"))))


def _apart(base: Column, wide: Column) -> Column:
    """The wide spans that touch no base span, in order; both are met in one sorted array."""
    is_base = lambda s: s["rank"] < len(KINDS)
    far = F.lit(2**62)

    def keep(v: Column) -> Column:
        n = F.size(v)
        ends = F.transform(v, lambda s: F.when(is_base(s), s["stop"]).otherwise(0))
        # the same from the other end: the least start of the base spans behind is the largest of what is left of `far`
        starts = F.reverse(F.transform(v, lambda s: F.when(is_base(s), far - s["start"]).otherwise(0)))
        apart = lambda stop, start: F.filter(v, lambda s, i: ~is_base(s) & (stop(i) <= s["start"]) & (far - start(n - 1 - i) >= s["stop"]))
        return running_max(ends, lambda stop: running_max(starts, lambda start: apart(stop, start)))

    return let(F.array_sort(F.concat(base, wide)), keep)


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict[tuple[str, tuple[int, ...]], float], dict[str, dict[int, tuple[float, float]]]]:
    """EM of a two-class model with independent labelers over counted vote patterns.

    Returns the posterior of every (kind, votes) and each labeler's P(vote | real), P(vote | not).  Start: a labeler is
    right three times in four.  Smoothing by one vote keeps every estimate inside (0, 1).
    """
    table = {n: {v: (0.5, 0.5) if v == 0 else ((0.75, 0.25) if v > 0 else (0.25, 0.75)) for v in (-1, 0, 1)} for n in VOTES}
    prior: dict[str, float] = {k: 0.5 for k, _, _ in patterns}
    post: dict[tuple[str, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for kind, v, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            odds += sum(math.log(table[n][x][0] / table[n][x][1]) for n, x in zip(VOTES, v, strict=True) if x)
            post[kind, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in prior:
            real = sum(c * post[k, v] for k, v, c in patterns if k == kind)
            prior[kind] = (real + 1) / (sum(c for k, _, c in patterns if k == kind) + 2)
        for i, n in enumerate(VOTES):
            real = {x: 1 + sum(c * post[k, v] for k, v, c in patterns if v[i] == x) for x in (-1, 0, 1)}
            rest = {x: 1 + sum(c * (1 - post[k, v]) for k, v, c in patterns if v[i] == x) for x in (-1, 0, 1)}
            table[n] = {x: (real[x] / sum(real.values()), rest[x] / sum(rest.values())) for x in (-1, 0, 1)}
    return post, table


def fit_classifier(rows: list[tuple[dict[str, float], float, float]], steps: int = 300, rate: float = 0.5) -> dict[str, float]:
    """Logistic regression on (features, target, weight) by gradient descent; plain numbers, a few hundred rows."""
    total = sum(w for _, _, w in rows) or 1.0
    theta: dict[str, float] = {"bias": 0.0}
    for _ in range(steps):
        grad: dict[str, float] = {}
        for x, y, w in rows:
            z = theta["bias"] + sum(theta.get(f, 0.0) * a for f, a in x.items())
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * w / total
            grad["bias"] = grad.get("bias", 0.0) + e
            for f, a in x.items():
                grad[f] = grad.get(f, 0.0) + e * a
        for f, g in grad.items():
            theta[f] = theta.get(f, 0.0) - rate * (g + 1e-4 * theta.get(f, 0.0))
    return theta


def _features(kind: str, v: tuple[int, ...], size: int) -> dict[str, float]:
    return {f"kind={kind}": 1.0, f"size={size}": 1.0} | {f"{n}={x}": 1.0 for n, x in zip(VOTES, v, strict=True) if x}


def _learned(found: DataFrame) -> dict[str, float]:
    """The span classifier of the votes in found."""
    seen = found.select(F.explode(F.concat("base", "wide")).alias("c")).select("c.*")
    counted = seen.groupBy("kind", *VOTES, "size").count().collect()  # at most kinds x 3^6 x 10 rows
    by_votes: dict[tuple[str, tuple[int, ...]], int] = {}
    for r in counted:
        key = (r["kind"], tuple(int(r[n]) for n in VOTES))
        by_votes[key] = by_votes.get(key, 0) + r["count"]
    post, _ = estimate([(k, v, c) for (k, v), c in by_votes.items()])
    return fit_classifier([(_features(r["kind"], v := tuple(int(r[n]) for n in VOTES), r["size"]), post[r["kind"], v], math.log1p(r["count"])) for r in counted])


def _accepted(theta: dict[str, float], threshold: float) -> Column:
    """All spans of a row in order: the base ones and the wide ones that the classifier takes."""

    def margin(c: Column) -> Column:
        z = F.lit(theta["bias"])
        for f, w in theta.items():
            if f != "bias":
                col, value = f.split("=", 1)
                z = z + F.when(c[col] == (F.lit(value) if col == "kind" else F.lit(int(value))), F.lit(w)).otherwise(F.lit(0.0))
        return z

    limit = math.log(threshold / (1 - threshold))
    return F.array_sort(_slim(F.concat("base", F.filter("wide", lambda c: margin(c) >= limit))))


def _slim(spans: Column) -> Column:
    return F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["stop"].alias("stop"), F.split_part(c["kind"], F.lit("/"), F.lit(1)).alias("kind")))


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, base and spans (arrays of start, rank, stop, kind, in order) for every row of docs."""
    found = candidates(doc_texts(docs)).persist(KEEP)
    return found.select("doc_id", _slim(F.col("base")).alias("base"), _accepted(_learned(found), threshold).alias("spans"))


def mask(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with every span in text replaced by its kind in brackets; all columns kept, nulls stay null.

    Overlapping spans are replaced together, under the kind of the first.  The classifier is learned in one scan and
    applied in a second, to spans found and cut in the same row: nothing is joined and no text is stored.
    """
    theta = _learned(candidates(doc_texts(docs)))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), row)
    found = candidates(src, ("text", "_row")).select("text", "_row", _accepted(theta, threshold).alias("spans"))

    masked = cut_out(F.col("text"), F.col("spans"), lambda s: F.concat(F.lit("["), s["kind"], F.lit("]")))
    clean = F.when(F.col("_row.text").isNull(), None).when(F.size("spans") == 0, F.col("_row.text")).otherwise(masked)
    return found.select(*((clean.alias(c) if c.lower() == "text" else F.col(f"_row.`{c}`").alias(c)) for c in docs.columns))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"], c["stop"])), ",")


def digest(detected: DataFrame) -> DataFrame:

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return detected.select("doc_id", *(n(k) for k in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

