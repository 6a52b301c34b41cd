"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from the base patterns (email, ip, card, phone) and from
wider ones (spelled-out email addresses, national phone numbers, credentials,
identity numbers).  Three labelers vote on each: a regex labeler (does the span keep the
stricter form that real ones have?), a gazetteer labeler (known domain endings, dialling
codes, card issuers' ranges, reserved addresses, key names, assigned area numbers) and a
context labeler (cue words just before the span).
Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability and a posterior for each pattern, without labelled data;
the posteriors train the final span classifier, a naive Bayes model over votes
and span features, and spans that it accepts join the base ones.

Texts are scanned twice: once for the counts by (kind, votes, features), a table of at most
``MAX_PATTERNS`` rows by construction that is written, and once for the spans.  Base spans
always stay; an added span never overlaps one.

Defined results: a null or empty text has no spans; rows are judged one by one
(ties, null ids, repeated rows); an empty table gives an empty result; extra
columns are ignored.  Patterns run in linear time and constant stack on very
long texts; credentials of any length are one span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import let, table, written

KINDS = ["email", "ip", "card", "phone", "secret", "id"]
LOCAL = r"A-Za-z0-9._%+-"
# The base patterns of the op10 contract. The look-behinds only skip starts that cannot match where the run's first one does not.
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD = r"[0-9][0-9\x20-]*[0-9]"
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# Wider candidates.
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z]{2,24}"
NATIONAL = r"(?<![0-9+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
SECRET = r"(?i)\b(?:token|secret|password|passwd|api_?key|access_?key|key)\x20?[=:]\x20?\"?[A-Za-z0-9+/_-]{8,}+\"?"
IDENTITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# Gazetteers (fixed values); runs of numbers are written as ranges.
ENDINGS = "com org net edu gov io co de fr es uk eu info".split()
KEY_NAMES = "token secret password passwd api_key apikey access_key".split()
#: Country dialling codes of ITU-T E.164.
DIALLING = "1 7 20 27 30-34 36 39-41 43-49 51-58 60-66 81 82 84 86 90-95 98 211-213 216 218 220-258 260-269 290 291 297-299 350-359 370-378 380-383 385-387 389 420 421 423 500-509 590-599 670 672-683 685-692 850 852 853 855 856 880 886 960-968 970-977 992-996 998"
#: Leading digits of card issuers.
ISSUERS = "4 34 36-39 51-55 62 65 300-305 644-649 2221-2720 3528-3589 6011"
#: First, first two or first three parts of addresses that no host on the net has.
RESERVED = r"^0*(?:0|10|127|2(?:2[4-9]|[34][0-9]|5[0-5]))\.|^0*169\.0*254\.|^0*192\.0*0\.0*2\.|^0*198\.0*51\.0*100\.|^0*203\.0*0\.0*113\."


def listed(ranges: str) -> str:
    """A pattern for texts that begin with one of the numbers."""
    numbers = [n for r in ranges.split() for n in range(int(r.split("-")[0]), int(r.split("-")[-1]) + 1)]
    return "^(?:" + "|".join(map(str, numbers)) + ")"


#: The stricter forms of the regex labeler, by kind; the span's digits are tested where it is by digits.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,62}\x20?(?:@|[\[(](?:at|AT)[\])])\x20?(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?))+[A-Za-z]{2,24}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{14,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5})$",
    "phone": r"^(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,4}$",
    "secret": r"[=:]\x20?\"?(?=[^\"]*[0-9])(?=[^\"]*[A-Za-z])[^\"]{16,}\"?$",
    "id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|contact|write|mail|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|from)\b",
    "card": r"(?i)\b(?:card|visa|credit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|t[eé]l[eé]phone|tel[eé]fono)\b",
    "secret": r"(?i)\b(?:login|auth|credential|export|config|header)\b",
    "id": r"(?i)\b(?:ssn|social security|id|passport)\b",
}
MAX_PATTERNS = len(KINDS) * 2**3 * 2 * 4
NONE = "array<struct<start:int,end:int,s:string,before:string>>"


def found(text: Column, pattern: str, shown: Column | None = None) -> Column:
    """All leftmost, non-overlapping matches with positions in code points.
    Texts between the matches, from split(), give the positions."""
    shown = text if shown is None else shown
    start = F.struct(F.lit(0).alias("at"), F.array().cast(NONE).alias("out"))

    def walk(ms: Column, gaps: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            m, gap = F.get(ms, i), F.get(gaps, i)
            a = acc["at"] + F.length(gap)
            b = a + F.length(m)
            return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), m.alias("s"), F.right(gap, F.lit(40)).alias("before")))).cast(NONE).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(ms) - 1), start, step, lambda acc: acc["out"])

    return let(F.regexp_extract_all(shown, F.lit(pattern), F.lit(0)), lambda ms: F.when(F.size(ms) == 0, F.array().cast(NONE)).otherwise(let(F.split(shown, pattern, -1), lambda gaps: walk(ms, gaps))))


def guarded(guard: Column, spans: Column) -> Column:
    """Most texts lack what a pattern needs; they skip it."""
    return F.when(guard, spans).otherwise(F.array().cast(NONE))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """True where the digit string d passes the Luhn check."""
    n = F.length(d)

    def step(acc: Column, i: Column) -> Column:
        x = F.substr(d, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def base_spans(t: Column) -> dict[str, Column]:
    digit = t.rlike("[0-9]")
    single = F.regexp_replace(t, r"[\x20-](?=[\x20-])|(?<=[\x20-])[\x20-]", "\u0001")
    size = lambda x: F.length(digits(x["s"]))
    return {
        "email": guarded(F.contains(t, F.lit("@")), found(t, EMAIL)),
        "ip": guarded(digit & t.rlike(r"[0-9]\.[0-9]"), F.filter(found(t, IP), lambda x: x["s"].rlike(rf"^(?:{PART}\.){{3}}{PART}$"))),
        "card": guarded(t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), F.filter(found(t, CARD, single), lambda x: size(x).between(14, 19) & let(digits(x["s"]), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)))),
        "phone": guarded(F.contains(t, F.lit("+")), F.filter(found(t, PHONE), lambda x: size(x).between(10, 15))),
    }


def wide_spans(t: Column) -> dict[str, Column]:
    return {
        "email": guarded(t.rlike(r"[\[(](?:at|AT)[\])]"), found(t, SPELLED)),
        "phone": guarded(t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), found(t, NATIONAL)),
        "secret": guarded(t.rlike(r"(?i)(?:token|secret|passw|key)[a-z]*\x20?[=:]"), found(t, SECRET)),
        "id": guarded(t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), found(t, IDENTITY)),
    }


def voted(kind: str, strict: bool, spans: Column) -> Column:
    """Candidates with the three labelers' votes and two features."""

    def one(x: Column) -> Column:
        low, d, t = F.lower(x["s"]), digits(x["s"]), x["s"]
        gazetteer = {
            "email": lambda: F.element_at(F.split(F.regexp_replace(low, r"[\[(]dot[\])]", "."), r"[.\s]+", -1), -1).isin(ENDINGS),
            "phone": lambda: d.rlike(listed(DIALLING)) if strict else d.rlike(r"^[2-9][0-8][0-9][2-9]"),  # national: assigned area and exchange codes
            "ip": lambda: ~t.rlike(RESERVED),
            "card": lambda: d.rlike(listed(ISSUERS)),
            "secret": lambda: F.regexp_extract(low, r"^[a-z_]+", 0).isin(KEY_NAMES),
            "id": lambda: d.cast("bigint").between(1_010_001, 772_999_999) & ~d.rlike(r"^(\d)\1+$"),
        }[kind]()
        feature = {"email": lambda: F.length(t) < 64, "secret": lambda: t.rlike('"'), "id": lambda: F.lit(True)}.get(kind, lambda: t.rlike(r"[().\x20-]"))()
        regex = t.rlike(STRICT[kind])
        votes = F.concat(*[F.when(v, "1").otherwise("0") for v in (regex, gazetteer, x["before"].rlike(CUES[kind]))])
        code = F.concat_ws("|", F.lit(kind), votes, F.when(F.lit(strict), "b").otherwise("w"), F.when(feature, "1").otherwise("0"))
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), x["end"].alias("end"), F.lit(kind).alias("kind"), code.alias("code"))

    return F.transform(spans, one)


def candidates(docs: DataFrame) -> DataFrame:
    """doc columns and text replaced by arrays of voted spans, base and wide."""
    t = F.coalesce(F.col("text"), F.lit(""))
    base, wide = base_spans(t), wide_spans(t)
    found_ = docs.select("*", *[c.alias(f"__b_{k}") for k, c in base.items()], *[c.alias(f"__w_{k}") for k, c in wide.items()])
    out = found_.select(*docs.columns, F.sort_array(F.concat(*[voted(k, True, F.col(f"__b_{k}")) for k in base])).alias("base"), F.concat(*[voted(k, False, F.col(f"__w_{k}")) for k in wide]).alias("wide"))
    apart = F.filter("wide", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return out.withColumn("wide", apart)


def reliabilities(patterns: DataFrame, steps: int = 30) -> DataFrame:
    """EM over patterns(code, n): code, n and the posterior p of its votes, by kind.
    One row per kind holds its pattern counts (at most 64), so a HOF does the steps."""
    cols = F.split("code", r"\|")
    rows = patterns.select("code", "n", cols[0].alias("kind"), cols[1].alias("votes"))
    by_kind = rows.groupBy("kind").agg(F.collect_list(F.struct(F.col("votes"), F.col("n").cast("double").alias("n"))).alias("rows"))
    one = lambda x: F.lit(float(x))
    first = F.struct(one(0.5).alias("prior"), F.array(one(0.8), one(0.8), one(0.6)).alias("hit"), F.array(one(0.2), one(0.2), one(0.1)).alias("slip"))

    def posterior(m: Column, votes: Column) -> Column:
        yes, no = m["prior"], 1 - m["prior"]
        for i in range(3):
            v = F.substr(votes, F.lit(i + 1), F.lit(1)) == "1"
            yes = yes * F.when(v, m["hit"][i]).otherwise(1 - m["hit"][i])
            no = no * F.when(v, m["slip"][i]).otherwise(1 - m["slip"][i])
        return yes / (yes + no)

    def step(m: Column, _: Column) -> Column:
        soft = F.transform("rows", lambda r: F.struct(r["votes"].alias("votes"), r["n"].alias("n"), (posterior(m, r["votes"]) * r["n"]).alias("y")))
        total = lambda a, f: F.aggregate(a, one(0), lambda acc, r: acc + f(r))

        def update(s: Column) -> Column:
            y, n = total(s, lambda r: r["y"]), total(s, lambda r: r["n"])
            on = lambda r, i: F.when(F.substr(r["votes"], F.lit(i + 1), F.lit(1)) == "1", 1.0).otherwise(0.0)
            hit = F.array(*[(total(s, lambda r, i=i: r["y"] * on(r, i)) + 4 * [0.8, 0.8, 0.6][i]) / (y + 4) for i in range(3)])
            slip = F.array(*[(total(s, lambda r, i=i: (r["n"] - r["y"]) * on(r, i)) + 4 * [0.2, 0.2, 0.1][i]) / (n - y + 4) for i in range(3)])
            return F.struct(((y + 2) / (n + 4)).alias("prior"), hit.alias("hit"), slip.alias("slip"))

        return let(soft, update)

    fitted = by_kind.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step).alias("m"))
    return rows.join(F.broadcast(fitted), "kind").select("code", "n", "kind", "votes", posterior(F.col("m"), F.col("votes")).alias("p"))


def classifier(patterns: DataFrame) -> DataFrame:
    """The final span classifier as a table (code, score): naive Bayes log odds of
    votes and features, trained on EM posteriors."""
    soft = reliabilities(patterns).withColumn("parts", F.split("code", r"\|"))
    soft = soft.withColumn("features", F.array(*[F.concat(F.lit(f"v{i}="), F.substr("votes", F.lit(i + 1), F.lit(1))) for i in range(3)], F.concat(F.lit("f="), F.col("parts")[3])))
    prior = soft.groupBy("kind").agg(F.sum(F.col("n") * F.col("p")).alias("py"), F.sum(F.col("n") * (1 - F.col("p"))).alias("pn"))
    weight = soft.select("kind", "n", "p", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(F.sum(F.col("n") * F.col("p")).alias("y"), F.sum(F.col("n") * (1 - F.col("p"))).alias("x"))
    odds = weight.join(F.broadcast(prior), "kind").select("kind", "feature", F.log((F.col("y") + 1) / (F.col("py") + 2) / ((F.col("x") + 1) / (F.col("pn") + 2))).alias("w"))
    score = soft.select("code", "kind", F.explode("features").alias("feature")).join(F.broadcast(odds), ["kind", "feature"]).groupBy("kind", "code").agg(F.sum("w").alias("w"))
    return score.join(F.broadcast(prior), "kind").select("code", (F.col("w") + F.log((F.col("py") + 1) / (F.col("pn") + 1))).alias("score"))


def detect(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with base and added spans: struct(start, k, end, kind, code)."""
    cand = candidates(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("text")
    patterns = written(cand.select(F.explode(F.concat("base", "wide")).alias("c")).groupBy("c.code").agg(F.count("*").alias("n")))
    accepted = [r.code for r in classifier(patterns).where("score > 0 and code like '%|w|%'").limit(MAX_PATTERNS).collect()]  # at most MAX_PATTERNS exist
    take = F.filter("wide", lambda w: w["code"].isin(accepted)) if accepted else F.slice("wide", 1, 0)
    return cand.select("doc_id", "base", take.alias("added"))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    d = detect(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return d.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(F.encode(text("base"), "UTF-8"), 256).alias("base_sha256"), text(F.sort_array(F.concat("base", "added"))).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
