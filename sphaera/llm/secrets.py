"""Secret scanning in DataFrame operations: wide candidate patterns, then a random forest that removes false findings.

Candidates are opaque tokens (16 or more of A-Z a-z 0-9 + / _ -, or fewer after a known prefix) and values assigned to a
telling name, up to their delimiter; of a candidate within another the wider one stays.  A random forest (Spark's own)
judges each by its length, its character transitions, how much of it dictionary words cover, whether it stands in a path,
and the words next to it.  It is trained from labelled findings, a table (text, secret):
labelled_findings() makes one of built texts of both kinds, and a caller may pass another.  Everything on the way is a
column expression or a JVM-side Spark ML stage.

Null texts are empty and have no findings; an empty table gives none.  Repeated rows give their findings once each, rows
with a null id findings with a null id; columns other than doc_id and text are not read.  Long runs of one character
take linear time: patterns are possessive and start only at the border of a run; so do texts of many candidates.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.llm.common import doc_texts
from sphaera.llm.spans import gaps, let, located, matches, running_max

TOKEN = "A-Za-z0-9+/_-"
PREFIX = "(?:AKIA|ASIA|gh[pousr]_|xox[abp]-|sk_live_|rk_live_|AIza|eyJ|glpat-|npm_)"
OPAQUE = rf"(?<![{TOKEN}])(?:[{TOKEN}]{{16,}}+|{PREFIX}[{TOKEN}]{{6,}}+)={{0,2}}+"
#: The name is in the context; lookbehinds must be bounded, so up to three characters may part it from the value.
ASSIGNED = r"(?<=(?:(?:[Pp]ass(?:word|wd|phrase)|PASSWORD|[Pp]wd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy]|[Aa]ccess[_-]?[Kk]ey|[Pp]rivate[_-]?[Kk]ey)[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?))[^\s\"',;]{6,}+"

# Word lists.
DICTIONARY = (
    "about above after again also because before being between both could down each even find first from give good great have help here house into just know large last life like line little long look made make many more most much name need next number only open order other over part people place point right same school should show small some state still such take than that their them then there these they thing think this those three time under very want water well what when where which while will with word work world would year your"
    " aber alle auch beim dass dein durch eine einer gegen haben jahr kann kein land leben mehr muss nach nicht noch oder ohne schon sein seine sich sind stadt teil unter viel wenn werden wieder wird zeit zwischen"
    " alors aussi autre avec bien cette comme dans depuis deux donc elle encore entre faire jour leur mais monde nous pour sans sont sous tout vous"
    " antes cada como cuando desde donde ella entre este hasta hombre lugar mundo nada nuevo otro para pero porque sobre tiempo todo vida"
    " data file user test value index model server client string table query node code date path info main core config default version build release"
).split()
SYLLABLES = "ver schaft ung tion ment keit heit lich gesell arbeit unter nehm wirt inter nat isa comp able ist mente dad eur pro gram krank haus ent wick lung respon sab ili contra dict trans form micro elec tro ander über auf gab zeit raum kraft werk".replace("ü", "ue").split()
BIGRAMS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch be ll ma si om ur ch ei ie ge un au qu ai ui os as do ad sc be ue eu ou em us il tr is ns".split()
#: Parts of built words, of which the training texts make many that no list holds.
ONSETS = "b c ch d f g h k l m n p pf qu r s sch st t th tr v w z".split()
NUCLEI = "a e e i o u ai au ei ie ou eau".split()
CODAS = ["", "", "n", "r", "s", "t", "nd", "nt", "ng", "ch", "x", "cht"]
CUE = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|login)[^\n]{0,12}$"
COUNTER = r"(?i)(?:sha-?(?:1|256|512)?|md5|crc|checksum|digest|commit|revision|hash|uuid|guid|etag|isbn|doi|order|invoice|card|visa|account|phone|tel|example|sample|dummy|test|integrity|image|file|path|href|src)[^\n]{0,12}$"
AFTER_COUNTER = r"(?i)^[\"']?[\x20]?(?:example|sample|dummy|checksum|\.(?:png|jpe?g|gif|pdf|zip|gz|html?|js|css|txt)\b)"

FEATURES = ("length", "digits", "upper", "lower", "marks", "switches", "bigrams", "vowels", "distinct", "coverage", "hex", "numeric", "uuid", "known_prefix", "in_path", "quoted", "assigned", "cue", "counter", "after_counter", "words_around")


def _share(hit: Column, pattern: str) -> Column:
    """Share of the token's characters that the pattern's matches cover."""
    return 1 - F.length(F.regexp_replace(hit, pattern, "")) / F.greatest(F.length(hit), F.lit(1))


def features(s: Column, kind: str) -> dict[str, Column]:
    hit, before, after = s["text"], s["before"], s["after"]
    n = F.greatest(F.length(hit), F.lit(1))
    low = F.lower(hit)
    yes = lambda c: c.cast("double")
    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a"), "+/_-=.", "######")
    switches = F.length(F.regexp_replace(classes, r"(.)(?=\1)", "")) - 1
    return {
        "length": F.least(n, F.lit(256)).cast("double"), "digits": _share(hit, "[0-9]"), "upper": _share(hit, "[A-Z]"), "lower": _share(hit, "[a-z]"), "marks": _share(hit, "[^A-Za-z0-9]"),
        "switches": switches / n, "bigrams": _share(low, "(?:" + "|".join(BIGRAMS) + ")"), "distinct": F.size(F.array_distinct(F.split(F.substring(low, 1, 256), ""))) / F.least(n, F.lit(36)),
        "vowels": _share(low, "[aeiouy]"), "coverage": _share(low, "(?:" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"), "hex": yes(hit.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), "numeric": yes(hit.rlike("^[0-9-]+$")),
        "uuid": yes(low.rlike("^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")), "known_prefix": yes(hit.rlike("^" + PREFIX)),
        "in_path": yes(hit.rlike("[^/]/[^/]") | before.rlike(r"(?:https?:|www\.|[./\\]|~)[^\s]{0,30}$") | after.rlike(r"^[./\\][A-Za-z]")), "quoted": yes(before.rlike("[\"']$") & after.rlike("^[\"']")), "assigned": yes(before.rlike(r"[=:]\x20?[\"']?$")) if kind != "assigned" else F.lit(1.0),
        "cue": yes(before.rlike(CUE)), "counter": yes(before.rlike(COUNTER)), "after_counter": yes(after.rlike(AFTER_COUNTER)), "words_around": yes(before.rlike(r"[a-z]{2,}[.,]?\x20$")) + yes(after.rlike(r"^\x20[A-Za-z]{2,}")),
    }


def candidates(texts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per candidate: doc_id, the columns in keep, start, stop, kind and the features.  texts: doc_id, text, keep."""
    text, none = F.col("text"), F.array().cast("array<string>")
    may = {"opaque": text.rlike(OPAQUE), "assigned": text.rlike(r"(?i)(?:pass|pwd|secret|token|key)[a-z]{0,6}[\"']?\x20{0,2}[=:]")}
    pattern = {"opaque": OPAQUE, "assigned": ASSIGNED}
    out = texts.withColumns({f"m_{k}": F.when(may[k], matches(text, p)).otherwise(none) for k, p in pattern.items()} | {f"g_{k}": F.when(may[k], gaps(text, p)).otherwise(none) for k, p in pattern.items()})
    out = out.select("doc_id", *keep, *(located(F.col(f"m_{k}"), F.col(f"g_{k}"), 48).alias(f"s_{k}") for k in pattern))

    def judged(kind: str) -> Column:
        return F.transform(F.col(f"s_{kind}"), lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), F.lit(kind != "opaque").alias("second"), F.lit(kind).alias("kind"), s["stop"].alias("stop"), s["text"].alias("text"), s["before"].alias("before"), s["after"].alias("after")))

    # of a value and an opaque token one of which holds the other, the wider is the finding: it comes first in this order
    def widest(v: Column) -> Column:
        stops = lambda second: F.transform(v, lambda s: F.when(s["second"] == F.lit(second), s["stop"]).otherwise(0))
        return running_max(stops(False), lambda opaque: running_max(stops(True), lambda value: F.filter(v, lambda s, i: s["stop"] > F.when(s["second"], opaque(i)).otherwise(value(i)))))

    both = F.array_sort(F.concat(judged("opaque"), judged("assigned")))
    one = (F.size("s_opaque") == 0) | (F.size("s_assigned") == 0)
    rows = out.select("doc_id", *keep, F.explode(F.when(one, both).otherwise(let(both, widest))).alias("s"))
    f = features(F.col("s"), "opaque")
    f["assigned"] = F.greatest(f["assigned"], (F.col("s.kind") == "assigned").cast("double"))
    return rows.select("doc_id", *keep, F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), F.col("s.kind").alias("kind"), *(f[n].cast("double").alias(n) for n in FEATURES))


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(doc_id, text, secret): built texts, half of them with a secret; all values follow from the row number."""
    i = F.col("id")
    h = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 256)
    b64 = F.translate(F.base64(F.unhex(h("b"))), "+/=", "xyz")
    pick = lambda words, salt: F.element_at(F.array(*(F.lit(w) for w in words)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    word = lambda salt: pick(DICTIONARY, salt)
    size = F.pmod(F.xxhash64(i, F.lit("size")), F.lit(25)).cast("int")
    name = pick(["password", "token", "secret", "api_key", "access_key", "passwd", "auth_token", "private_key"], "name")
    gap, quote = pick(["=", ": ", " = ", "="], "gap"), pick(["", '"', "'"], "quote")
    digits = F.regexp_replace(F.conv(F.substring(h("d"), 1, 15), 16, 10), "^0+", "1")
    letters = F.translate(b64, "0123456789", "qKzWxJvHpY")
    syllable = lambda salt: pick(SYLLABLES, salt)
    built = F.concat(*(pick(parts, f"{parts[-1]}{k}") for k in range(9) for parts in (ONSETS, NUCLEI, CODAS)))
    long = F.substring(F.col("built"), F.lit(1), size + 16)
    secret = [
        F.concat(name, gap, quote, F.substring(h("x"), F.lit(1), size + 16), quote), F.concat(name, gap, quote, F.substring(b64, F.lit(1), size + 16), quote), F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(b64, "0189", "2345"), 1, 16))),
        F.concat(pick(["ghp_", "sk_live_", "xoxb-", "AIza", "glpat-"], "prefix"), F.substring(b64, 1, 36)), F.concat(F.lit("Bearer "), b64), F.concat(name, gap, F.substring(b64, F.lit(1), F.lit(8) + size % 6)),
        F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 1, 16))), F.substring(letters, F.lit(1), size + 16), F.substring(b64, F.lit(1), size + 16), F.concat(name, gap, quote, F.substring(b64, 1, 4), F.lit("!$"), F.substring(b64, F.lit(5), size + 16), quote),
    ]
    plain = [
        F.concat(F.lit("4"), F.substring(F.rpad(digits, 15, "7"), 1, 15)), F.concat(pick(["sha256: ", "md5 ", "commit ", "checksum=", "digest: "], "sum"), h("c")), F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12)),
        F.concat_ws("/", F.lit(""), word("p1"), word("p2"), word("p3"), F.concat(word("p4"), size)), F.concat_ws("_", word("w1"), word("w2"), word("w3"), size.cast("string")), F.concat(F.lit("https://"), word("h1"), F.lit(".example.com/"), word("h2"), F.lit("/"), F.substring(h("l"), 1, 20)),
        F.concat_ws("-", word("d1"), F.lit("2024-05-17"), word("d2"), word("d3")), F.concat(name, gap, word("v1"), F.lit("_"), word("v2")),
        F.concat(*(syllable(f"y{k}") for k in range(5)), F.lit("schaft")), F.initcap(F.concat(*(syllable(f"z{k}") for k in range(6)), F.lit("ation"))), F.concat(*(F.initcap(syllable(f"c{k}")) for k in range(5)), F.initcap(word("c5"))),
        F.replace(F.concat_ws("-", word("k1"), syllable("k2"), word("k3"), F.concat(syllable("k4"), syllable("k5")), word("k6")), F.lit("-"), pick(["-", "_", "/"], "mark")), F.upper(F.concat_ws("_", word("u1"), syllable("u2"), word("u3"), F.concat(syllable("u4"), syllable("u5")))),
        F.upper(F.concat(*(syllable(f"v{k}") for k in range(4)), word("v4"), F.lit("ation"))), F.upper(F.concat_ws("_", word("u6"), F.concat(syllable("u7"), syllable("u8"), F.lit("ion")), F.concat(syllable("u9"), F.lit("ies")))),
        F.upper(long), F.upper(F.reverse(long)), F.initcap(long), long, F.concat(name, gap, F.substring(F.col("built"), 1, 9)),
        F.repeat(pick(["-", "_", "a", "/", "+-", "x", "ha"], "rule"), size * 3 + 16),
    ]
    one = lambda options, salt: F.element_at(F.array(*options), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    yes = i % 2 == 0
    text = F.concat_ws(" ", word("a"), word("b"), F.when(yes, one(secret, "s")).otherwise(one(plain, "t")), word("c"), word("e"))
    return spark.range(0, n, 1, 2).withColumn("built", built).select(i.alias("doc_id"), text.alias("text"), yes.cast("double").alias("secret"))


def train(findings: DataFrame, trees: int = 24, depth: int = 7) -> RandomForestClassificationModel:
    rows = candidates(findings, ("secret",))
    return RandomForestClassifier(featuresCol="features", labelCol="secret", numTrees=trees, maxDepth=depth, seed=11).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Findings that the forest holds for secrets: doc_id, start, stop (code points), kind, score."""
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(candidates(doc_texts(docs)))
    judged = model.transform(rows).select("doc_id", "start", "stop", "kind", vector_to_array("probability")[1].alias("score"))
    return judged.where(F.col("score") >= threshold)
