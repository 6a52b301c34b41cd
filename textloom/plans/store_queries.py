"""Registered queries of sources, sinks, runs, streams and small functions, with oracle SQL.

Queries of sinks write whole tables to the run's shared folder and read them back.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from textloom.config import Config
from textloom.functions import scalars as S
from textloom.operators import collect, evaluate, labeling, lexicon
from textloom.plans.queries import HASH, PREDICTED, RANKED, RATERS, TRUTH, basic_sql, docs, lit, posts, predicted, query, raters, table, truth, with_texts, words
from textloom.sources import io, shared
from textloom.streaming import stream

EVENTS = "event_id, user_id, event_type, value"


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


# ---- files ----


@query("csv_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf):
    at = shared.fresh(spark, "csv")
    d = table(spark, sf, "documents")
    io.write_csv(d, at)
    return io.read_csv(spark, at, d.schema)


@query("csv_missing_is_empty", "SELECT 'missing' AS name, 0::BIGINT AS n UNION ALL SELECT 'nation', count(*) FROM nation")
def _(spark, sf):
    at, n = shared.fresh(spark, "csv"), table(spark, sf, "nation")
    io.write_csv(n, at)
    found = [io.read_csv_or_empty(spark, p, n.schema).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, p in (("missing", at + "_none"), ("nation", at))]
    return found[0].unionByName(found[1])


@query("word_list_scan", "SELECT DISTINCT lower(p_name) AS word FROM part")
def _(spark, sf):
    at, p = shared.fresh(spark, "words"), table(spark, sf, "part")
    lines = p.select(F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t")).alias("value")).union(p.select(F.concat(F.lit("; "), "p_type"))).union(p.select(F.lit(" ")))
    lines.write.text(at)
    return io.word_list(spark, at)


@query("embedding_file_scan", "SELECT 'w' || vec_id AS word, len(embedding)::INT AS dim, round(embedding[1]::DOUBLE * CASE WHEN vec_id % 9 = 0 THEN 2 ELSE 1 END, 6) AS first FROM embeddings WHERE vec_id % 3 = 0")
def _(spark, sf):
    at, e = shared.fresh(spark, "vectors"), table(spark, sf, "embeddings")
    line = lambda by: F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), F.array_join(F.transform("embedding", lambda x: (x.cast("double") * by).cast("string")), " ")).alias("value")
    again = e.where("vec_id % 9 = 0").select(line(2))  # of repeated words the last line counts
    e.select(line(1)).union(e.select(F.concat(F.lit("short "), "vec_id"))).union(again).coalesce(1).write.text(at)
    wanted = e.where("vec_id % 3 = 0").select(F.concat(F.lit("w"), "vec_id").alias("word"))
    v = io.embeddings(spark, at, wanted)
    return v.select("word", F.size("vec").alias("dim"), F.round(F.col("vec")[0], 6).alias("first"))


@query("json_report", "SELECT r_name AS name, count(n_nationkey) AS nations FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL")
def _(spark, sf):
    at = shared.fresh(spark, "report") + ".json"
    per = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("n"))
    io.write_json(spark, {r.r_name: r.n for r in per.collect()}, at)  # a report: a row a region
    back = io.read_json(spark, at)
    assert io.read_json(spark, at + ".none") is None
    return spark.createDataFrame(list(back.items()), "name string, nations long")


@query("json_rows", f"SELECT {EVENTS}, props::JSON->>'k' AS k FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.to_json(F.struct(*EVENTS.split(", "), "props")).alias("j"))
    back = F.from_json("j", "event_id long, user_id long, event_type string, value double, props string")
    return e.select(back.alias("r")).select(*[f"r.{c}" for c in EVENTS.split(", ")], F.get_json_object("r.props", "$.k").alias("k"))


# ---- runs and the cumulative store ----
DAYS = [datetime(2024, 1, d, 1, 2, 3, tzinfo=timezone.utc) for d in (1, 2, 3)]


@query("latest_run_rows", f"SELECT {EVENTS}, '20240103T010203Z' AS run_id FROM events WHERE event_id % 3 = 2")
def _(spark, sf):
    at = shared.fresh(spark, "runs")
    for i, day in enumerate(DAYS):
        io.write_run({"events": events(spark, sf).where(F.col("event_id") % 3 == i)}, io.run_id(day), at)
    return io.read_latest_run(spark, at, "events")


@query("run_discovery", "SELECT * FROM (VALUES ('latest', 'run_20240103T010203Z'), ('preferred', 'run_20240102T010203Z_groq'), ('with_child', 'run_20240101T010203Z/nation'), ('none', NULL)) t(kind, name)")
def _(spark, sf):
    at, n = shared.fresh(spark, "found"), table(spark, sf, "nation")
    for day, suffix, child in zip(DAYS, ("", "_groq", ""), ("nation", "other", "other")):
        n.write.parquet(f"{at}/run_{io.run_id(day)}{suffix}/{child}")
    found = {"latest": io.latest_run(spark, at), "preferred": io.latest_run(spark, at, suffix="_groq"), "with_child": io.latest_with(spark, at, "nation"), "none": io.latest_run(spark, at + "/none")}
    return spark.createDataFrame([(k, v and v.removeprefix(at + "/")) for k, v in found.items()], "kind string, name string")


def _appended(spark, sf):
    at, o = shared.fresh(spark, "store"), table(spark, sf, "orders")
    first = {"orders": o.select("o_orderkey", "o_totalprice"), "nation": table(spark, sf, "nation")}
    again = {"orders": o.select("o_orderkey", "o_totalprice", "o_orderstatus"), "nation": table(spark, sf, "nation").where("n_regionkey = 1")}
    stats = [io.append_to_store(d, io.run_id(day), day.isoformat(), at) for d, day in zip((first, again), DAYS)]
    return at, stats


@query("store_append", """SELECT o_orderkey, o_totalprice, NULL AS o_orderstatus, '20240101T010203Z' AS source_run_id, '2024-01-01T01:02:03+00:00' AS ingested_at_utc FROM orders
UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus, '20240102T010203Z', '2024-01-02T01:02:03+00:00' FROM orders""")
def _(spark, sf):
    """The same rows twice: the store never deduplicates across runs."""
    return io.read_store(spark, _appended(spark, sf)[0], "orders")


@query("store_stats", """WITH s AS (SELECT 1 AS run, 'orders' AS dataset, 0 AS existing_rows, count(*) AS incoming_rows, count(*) AS final_rows, 4 AS columns_count FROM orders
UNION ALL SELECT 2, 'orders', count(*), count(*), 2 * count(*), 5 FROM orders UNION ALL SELECT 1, 'nation', 0, count(*), count(*), 5 FROM nation
UNION ALL SELECT 2, 'nation', count(*), count(*) FILTER (n_regionkey = 1), count(*) + count(*) FILTER (n_regionkey = 1), 5 FROM nation)
SELECT s.*, (SELECT sum(final_rows) FROM s t WHERE t.run = s.run)::BIGINT AS run_total FROM s""")
def _(spark, sf):
    rows = [(i, name, x["existing_rows"], x["incoming_rows"], x["final_rows"], x["columns_count"], io.run_totals(s)) for i, s in enumerate(_appended(spark, sf)[1], 1) for name, x in s.items()]
    return spark.createDataFrame(rows, "run int, dataset string, existing_rows long, incoming_rows long, final_rows long, columns_count int, run_total long")


@query("metric_union", f"WITH {RATERS} " + " UNION ALL ".join(f"SELECT '{r}' AS rater, {r} AS label, count(*) AS n FROM ra GROUP BY ALL" for r in ("r1", "r2", "r3")))
def _(spark, sf):
    ra = raters(spark, sf)
    return io.union_all([ra.groupBy(F.lit(r).alias("rater"), F.col(r).alias("label")).agg(F.count("*").alias("n")) for r in ("r1", "r2", "r3")])


# ---- streams ----


def _stream(spark, sf, name):
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query("stream_append", f"SELECT {EVENTS} FROM events")
def _(spark, sf):
    """Two starts over one checkpoint append every row once."""
    at = shared.fresh(spark, "stream")
    for _ in range(2):
        stream.run_available(_stream(spark, sf, "events").select(*EVENTS.split(", ")), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf):
    at = shared.fresh(spark, "stream")
    stream.run_available(_stream(spark, sf, "events"), f"{at}/out", f"{at}/checkpoint", lambda s: stream.dedup_stream(s.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"))
    return spark.read.parquet(f"{at}/out")


# ---- columns ----


@query("column_order", "SELECT * FROM (VALUES (1, 'source'), (2, 'text'), (3, 'doc_id'), (4, 'lang'), (5, 'n_chars')) t(position, name)")
def _(spark, sf):
    d = io.preferred_first(table(spark, sf, "documents"), ["source", "absent", "text"])
    return spark.createDataFrame(list(enumerate(d.columns, 1)), "position int, name string")


@query("text_column_choice", "SELECT doc_id, lang AS v1, source AS v2, source AS literal, text AS plain, lang AS processed FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    v = d.select("doc_id", "text", F.col("lang").alias("v1_basic_text"), F.col("source").alias("v2_no_stop_text"))
    both = v.withColumn("processed_text", F.col("v1_basic_text"))
    pick = {"v1": io.text_column(v, "v1"), "v2": io.text_column(v, "v2"), "literal": io.text_column(v, "v2_no_stop"), "plain": io.text_column(v), "processed": io.text_column(both)}
    return both.select("doc_id", *[F.col(c).alias(name) for name, c in pick.items()])


@query("label_codes", f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE {TRUTH} END AS label FROM labels) SELECT doc_id, CASE label WHEN 'negative' THEN 0 WHEN 'positive' THEN 2 ELSE 1 END AS code, CASE WHEN label = 'unknown' THEN 'neutral' ELSE label END AS label FROM t")
def _(spark, sf):
    code = S.encode_label(F.when(F.col("doc_id") % 7 == 0, "unknown").otherwise(F.col("label")))
    return truth(spark, sf).select("doc_id", code.alias("code"), S.decode_label(code).alias("label"))


@query("improvement", "SELECT event_id, round((value / nullif(user_id % 5, 0) - 1) * 100, 6) AS improvement FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(S.improvement(F.col("value"), F.col("user_id") % 5), 6).alias("improvement"))


@query("percent_text", "SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'n/a' ELSE printf('%.2f%%', (event_id % 997) / 7919 * 100) END AS shown FROM events")
def _(spark, sf):
    v = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise((F.col("event_id") % 997) / 7919)
    return table(spark, sf, "events").select("event_id", S.percent_text(v).alias("shown"))


@query("best_source", "SELECT source, avg(n_chars) AS mean_chars FROM documents GROUP BY source ORDER BY mean_chars DESC, source LIMIT 1")
def _(spark, sf):
    per = table(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("mean_chars"))
    return evaluate.best_of(per, "mean_chars", "source")


@query("config_from_env", "SELECT * FROM (VALUES ('geo', 'US'), ('grid', 'small'), ('missing', 'API_KEY'), ('neutral_margin', '0.1'), ('sort_modes', 'top,new'), ('strict', 'True'), ('top_k', '50')) t(name, value)")
def _(spark, sf):
    env = {"TEXTLOOM_GEO": "US", "TEXTLOOM_NEUTRAL_MARGIN": "0.1", "TEXTLOOM_SORT_MODES": "top, new,", "TEXTLOOM_STRICT": "yes", "TEXTLOOM_TOP_K": "50", "MODEL": "m"}
    c = Config.from_env(env=env)
    rows = [("geo", c.geo), ("grid", c.grid), ("missing", ",".join(c.missing(["MODEL", "API_KEY"], env))), ("neutral_margin", str(c.neutral_margin)), ("sort_modes", ",".join(c.sort_modes)), ("strict", str(c.strict)), ("top_k", str(c.top_k))]
    return spark.createDataFrame(rows, "name string, value string")


# ---- labelling ----
_TEXT = lambda p: f"{lit(p.split('{text}')[0])} || substr(text, 1, 2500) || {lit(p.split('{text}')[1])}"
_RATED = [f"CASE WHEN length({_TEXT(p)}) % 7 = 0 THEN 'neutral' WHEN length({_TEXT(p)}) % 3 = 0 THEN 'positive' WHEN length({_TEXT(p)}) % 3 = 1 THEN 'negative' ELSE 'neutral' END" for p in S.PROMPTS]
_LABELLED = f"r AS (SELECT doc_id, {', '.join(f'{c} AS r{i}' for i, c in enumerate(_RATED, 1))} FROM documents)"


def rater(prompt: str) -> str:
    """A deterministic stand-in for a service, which fails for some prompts."""
    if len(prompt) % 7 == 0:
        raise ValueError("no answer")
    return [" Positive.", "negative!", "NEUTRAL"][len(prompt) % 3]


@query("label_three_prompts", f"WITH {_LABELLED} SELECT doc_id, r1 AS label_prompt_1, r2 AS label_prompt_2, r3 AS label_prompt_3, CASE WHEN r1 = r2 OR r1 = r3 THEN r1 WHEN r2 = r3 THEN r2 ELSE 'neutral' END AS final_label FROM r")
def _(spark, sf):
    return labeling.label_texts(docs(spark, sf), rater, "none", "m")[0].drop("text")


@query("label_new_cache", " UNION ".join(f"SELECT sha256('none::m::' || {_TEXT(p)}) AS cache_key, {c} AS label FROM documents WHERE length({_TEXT(p)}) % 7 <> 0" for p, c in zip(S.PROMPTS, _RATED)))
def _(spark, sf):
    """Fallbacks of failed calls are not cached."""
    return labeling.label_texts(docs(spark, sf), rater, "none", "m")[1]


@query("label_fallback", f"SELECT doc_id, {TRUTH} AS label_prompt_1, {TRUTH} AS label_prompt_2, {TRUTH} AS label_prompt_3, {TRUTH} AS final_label FROM labels")
def _(spark, sf):
    t = truth(spark, sf).select("doc_id", "label")
    return labeling.label_texts(t, None, fallback="label")[0].drop("label")


# ---- polarity and enrichment ----
VALENCE = [("with", 1.9), ("this", 1.2), ("from", 0.8), ("that", -1.5), ("than", -2.1)]
IDIOMS = [("of the", 0.7), ("to be", -1.1)]


def polarity_sql(source: str, key: str, text: str, idioms) -> str:
    """The rules as window functions; idioms are joined by an underscore first."""
    body = f"coalesce({text}, '')"
    for phrase, _ in idioms:
        # RE2 has no look-around: twice, as neighbouring matches share a border.
        for _ in range(2):
            body = f"regexp_replace({body}, '(?i)(^|[^\\p{{L}}\\p{{N}}''_]){phrase.replace(' ', chr(92) + 's+')}($|[^\\p{{L}}\\p{{N}}''_])', '\\1{phrase.replace(' ', '_')}\\2', 'g')"
    rows = [*VALENCE, *((p.replace(" ", "_"), x) for p, x in idioms)]
    caps = "(mixed AND w = upper(w) AND w <> lower(w) AND length(w) > 1)"
    return f"""va(low, valence) AS (VALUES {', '.join(f"({lit(a)}, {b}::DOUBLE)" for a, b in rows)}),
pw AS (SELECT {key} AS k, regexp_extract_all({body}, '[\\p{{L}}\\p{{N}}''_]+') AS w, len(regexp_extract_all(coalesce({text}, ''), '!')) AS x, len(regexp_extract_all(coalesce({text}, ''), '\\?')) AS q FROM {source}),
pm AS (SELECT k, w AS ws, least(x, 4) * 0.292 + CASE WHEN q <= 1 THEN 0 WHEN q <= 3 THEN q * 0.18 ELSE 0.96 END AS amp, list_position(list_transform(w, lambda a: lower(a)), 'but') AS but,
  len(list_filter(w, lambda a: a = lower(a))) > 0 AND len(list_filter(w, lambda a: a = upper(a) AND a <> lower(a) AND length(a) > 1)) > 0 AS mixed FROM pw),
pe AS (SELECT k, amp, coalesce(but, 0) AS but, mixed, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM pm),
ps AS (SELECT *, lower(w) AS low, CASE WHEN lower(w) IN {tuple(lexicon.BOOSTERS)} THEN 0.293 WHEN lower(w) IN {tuple(lexicon.DAMPENERS)} THEN -0.293 END AS st FROM pe),
pd AS (SELECT *, coalesce(st + CASE WHEN {caps} THEN sign(st) * 0.733 ELSE 0 END, 0) AS degree FROM ps),
pn AS (SELECT *, coalesce(lag(degree, 1) OVER o, 0) + coalesce(lag(degree, 2) OVER o, 0) * 0.95 + coalesce(lag(degree, 3) OVER o, 0) * 0.9 AS push,
  coalesce(max(CASE WHEN list_contains({words(lexicon.NEGATORS)}, low) THEN 1 END) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) = 1 AS negated FROM pd WINDOW o AS (PARTITION BY k ORDER BY i)),
pv AS (SELECT k, amp, CASE WHEN st IS NOT NULL THEN 0.0 ELSE coalesce((valence + sign(valence) * (CASE WHEN {caps} THEN 0.733 ELSE 0 END + push)) * CASE WHEN negated THEN -0.74 ELSE 1 END
  * CASE WHEN but = 0 OR i = but THEN 1.0 WHEN i < but THEN 0.5 ELSE 1.5 END, 0.0) END AS v FROM pn LEFT JOIN va USING (low)),
pa AS (SELECT k, max(amp) AS amp, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p, sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS n, count(*) FILTER (v = 0) AS z FROM pv GROUP BY k),
pb AS (SELECT k, z, s + sign(s) * amp AS s, p + CASE WHEN p > n THEN amp ELSE 0 END AS p, n + CASE WHEN n > p THEN amp ELSE 0 END AS n FROM pa),
polarity AS (SELECT k, n / (p + n + z) AS neg, z / (p + n + z) AS neu, p / (p + n + z) AS pos, s / sqrt(s * s + 15) AS compound FROM pb)"""


def valence(spark):
    return spark.createDataFrame(VALENCE, "word string, valence double")


@query("polarity_scores", f"WITH {polarity_sql('documents', 'doc_id', 'text', IDIOMS)} SELECT doc_id, round(coalesce(neg, 0), 6) + 0.0 AS neg, round(coalesce(neu, 1), 6) + 0.0 AS neu, round(coalesce(pos, 0), 6) + 0.0 AS pos, round(coalesce(compound, 0), 6) + 0.0 AS compound FROM documents LEFT JOIN polarity ON doc_id = k")
def _(spark, sf):
    out = lexicon.polarity_scores(docs(spark, sf), valence(spark), idioms=IDIOMS)
    return out.select("doc_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("neg", "neu", "pos", "compound")])


_POSTS = """p AS (SELECT doc_id AS post_id, source AS subreddit, CASE WHEN lang = 'en' THEN 'the' ELSE 'que' END AS term, trim(split_part(text, chr(10), 1), e' \\t\\r') AS title,
  trim(CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END, e' \\t\\r\\n') AS selftext, n_chars AS score, doc_id * 3607.5 + 1700000000 AS created_utc, lang FROM documents),
f AS (SELECT *, trim(title || ' ' || selftext, e' \\t\\r\\n') AS full_text, make_timestamp((created_utc * 1000000)::BIGINT) AS ts FROM p),
u AS (SELECT DISTINCT full_text FROM f),
nw AS (SELECT CASE WHEN lang = 'en' THEN 'the' WHEN lang = 'fr' THEN 'que' ELSE lang END AS term, md5(text) AS title, row_number() OVER (PARTITION BY CASE WHEN lang = 'en' THEN 'the' WHEN lang = 'fr' THEN 'que' ELSE lang END ORDER BY n_chars DESC, doc_id) AS r FROM documents),
ng AS (SELECT term, count(*) AS n, string_agg(title, ',' ORDER BY r) AS titles FROM nw WHERE r <= 3 GROUP BY term)"""


@query("post_enrichment_34", f"""WITH {_POSTS}, {polarity_sql('u', 'full_text', 'full_text', [])}
SELECT f.term, (length(f.term) - 2)::BIGINT AS trend_rank, post_id, subreddit, f.title, selftext, score, 0::BIGINT AS num_comments, score AS engagement, round(score / 100000, 6) AS upvote_ratio, post_id % 2 = 0 AS is_self, post_id % 3 = 0 AS over_18,
  NULL::BOOLEAN AS locked, NULL::BOOLEAN AS stickied, created_utc::DOUBLE AS created_utc, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS created_datetime_utc,
  strftime(ts, '%A') AS created_day_of_week_utc, hour(ts)::INT AS created_hour_utc, 'http://x/' || post_id AS url, NULL::VARCHAR AS permalink, 'top' AS search_sort, length(f.title)::INT AS title_char_len, length(selftext)::INT AS selftext_char_len,
  length(full_text)::INT AS text_char_len, length(selftext) > 0 AS has_selftext, contains(lower(f.title), f.term) AS term_in_title, contains(lower(selftext), f.term) AS term_in_selftext, coalesce(ng.n, 0)::BIGINT AS news_count_for_term, coalesce(titles, '') AS related_news_titles,
  round(coalesce(compound, 0), 6) + 0.0 AS compound, round(coalesce(neg, 0), 6) + 0.0 AS neg, round(coalesce(neu, 1), 6) + 0.0 AS neu, round(coalesce(pos, 0), 6) + 0.0 AS pos, CASE WHEN coalesce(compound, 0) >= 0.05 THEN 'positive' WHEN coalesce(compound, 0) <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label
FROM f LEFT JOIN polarity ON k = full_text LEFT JOIN ng ON ng.term = f.term""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    news = collect.news_for_terms(d.select(F.when(F.col("lang") == "en", "the").when(F.col("lang") == "fr", "que").otherwise(F.col("lang")).alias("term"), F.md5(F.encode("text", "UTF-8")).alias("title"), F.col("n_chars").alias("relevance"), F.col("doc_id").alias("url")), 3)
    p = posts(spark, sf).withColumns({"trend_rank": (F.length("term") - 2).cast("long"), "upvote_ratio": F.round(F.col("score").cast("long") / 100000, 6), "is_self": F.when(F.col("post_id") % 2 == 0, True), "over_18": F.col("post_id") % 3 == 0, "url": F.concat(F.lit("http://x/"), "post_id"), "search_sort": F.lit("top")})
    out = collect.enriched_columns(collect.enrich(p, news, valence=valence(spark)))
    return out.withColumns({**{c: F.round(c, 6) + 0.0 for c in ("compound", "neg", "neu", "pos")}, "related_news_titles": F.array_join("related_news_titles", ","), "created_utc": F.col("created_utc").cast("double")})


# ---- acceptance and conclusion ----


#: d(test, cv): macro F1 of random labels on the test rows and over folds of the others.
DUMMY = f"""{RANKED}, sp AS (SELECT doc_id, label, CASE WHEN k <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' ELSE 'train' END AS split, CASE ('0x' || substr({HASH}, 1, 8))::BIGINT % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS pred FROM r),
nt AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH}, doc_id) AS j FROM sp WHERE split = 'train'),
kf AS (SELECT CASE WHEN min(c) >= 3 THEN 3 ELSE 2 END AS folds FROM (SELECT count(*) AS c FROM nt GROUP BY label)),
ev AS (SELECT 'test' AS part, label, pred FROM sp WHERE split = 'test' UNION ALL SELECT 'cv' || (j % folds), label, pred FROM nt, kf),
lb(l) AS (VALUES ('negative'), ('neutral'), ('positive')),
c AS (SELECT part, l, count(*) FILTER (label = l AND pred = l) AS tp, count(*) FILTER (label = l) AS su, count(*) FILTER (pred = l) AS pr FROM ev, lb GROUP BY ALL),
m AS (SELECT part, sum(coalesce(2 * (tp / nullif(pr, 0)) * (tp / nullif(su, 0)) / nullif(tp / nullif(pr, 0) + tp / nullif(su, 0), 0), 0)) / 3 AS f1 FROM c GROUP BY part),
d AS (SELECT any_value(f1) FILTER (part = 'test') AS test, avg(f1) FILTER (part <> 'test') AS cv FROM m)"""


@query("acceptance_check", f"""{DUMMY}
SELECT name, best, round(test, 6) AS dummy_test, round(cv, 6) AS dummy_cv, coalesce(best >= 1.2 * test, false) AS meets_test, coalesce(best >= 1.2 * cv, false) AS meets_cv FROM d, (VALUES ('good', 0.9::DOUBLE), ('poor', 0.05::DOUBLE), ('none', NULL)) t(name, best)""")
def _(spark, sf):
    from textloom.operators import models, sampling

    d = models.dummy_scores(sampling.stratified_split(truth(spark, sf), "label")).first()
    rows = [(n, b, round(d.dummy_test_macro_f1, 6), round(d.dummy_cv_macro_f1, 6), evaluate.accepted(b, d.dummy_test_macro_f1), evaluate.accepted(b, d.dummy_cv_macro_f1)) for n, b in (("good", 0.9), ("poor", 0.05), ("none", None))]
    return spark.createDataFrame(rows, "name string, best double, dummy_test double, dummy_cv double, meets_test boolean, meets_cv boolean")


@query("error_conclusion", f"""{PREDICTED}, ms AS (SELECT list_filter(string_split({basic_sql('text', False)}, ' '), lambda w: w <> '') AS w FROM pr JOIN documents USING (doc_id) WHERE true_label <> pred_label),
ct AS (SELECT greatest(6, floor(quantile_cont(len(w), 0.25)))::BIGINT AS cut FROM ms),
er AS (SELECT any_value(cut) AS cut, count(*) AS n, avg((len(w) <= cut)::INT) AS short, avg(list_has_any(w, {words(evaluate.NEGATION_WORDS)})::INT) AS neg FROM ms, ct),
top AS (SELECT true_label AS t, pred_label AS p FROM pr WHERE true_label <> pred_label GROUP BY ALL ORDER BY count(*) DESC, t, p LIMIT 1)
SELECT 'Error analysis' || chr(10) || 'Misclassified samples analyzed: ' || n || chr(10) || 'Most errors are true ''' || t || ''' predicted as ''' || p || '''.' || chr(10) || printf('%.0f%%', short * 100) || ' of the errors are short texts (at most ' || cut || ' tokens).' || chr(10)
  || printf('%.0f%%', neg * 100) || ' of the errors contain an explicit negation' || CASE WHEN neg >= 0.3 THEN ': negation matters.' ELSE ': negation isn''t what drives them.' END AS conclusion FROM er, top""")
def _(spark, sf):
    from textloom.functions.clean import serving_clean

    p = shared.written(predicted(spark, sf))
    wrong = with_texts(spark, sf, evaluate.misclassified(p, "true_label", "pred_label")).withColumn("clean_text", serving_clean(F.col("text")))
    pairs = [r.asDict() for r in evaluate.confusion_pairs(p, "true_label", "pred_label").collect()]  # ten rows at most
    return spark.createDataFrame([(evaluate.conclusion(evaluate.error_patterns(wrong).first().asDict(), pairs),)], "conclusion string")
