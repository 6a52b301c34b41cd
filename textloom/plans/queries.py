"""Registered queries of the text-analytics operators, with their oracle SQL.

Every query reads its whole tables.  ``documents`` stand for posts (doc_id,
source as subreddit, lang as term), ``events`` for engagement and times,
``labels`` for ground truth, ``embeddings`` for document vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import clean as C
from textloom.functions import scalars as S
from textloom.functions import tokens as T
from textloom.operators import bayes, collect, corpus, evaluate, labeling, lexicon, sampling
from textloom.sources import io
from textloom.sources.shared import read_table, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet") if name in ("documents", "pages", "conversations") else spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


# ---- SQL building blocks, written for DuckDB ----


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(ws) -> str:
    return "[" + ", ".join(lit(w) for w in ws) + "]"


def gsub(x: str, pattern: str, by: str = "' '") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {by}, 'g')"


def squeeze(x: str) -> str:
    return f"trim({gsub(x, chr(92) + 's+')})"


def basic_sql(x: str, tags: bool = True) -> str:
    x = f"lower(coalesce({x}, ''))"
    for p in [C.URL] + [C.TAG] * tags + [C.NON_WORD]:
        x = gsub(x, p)
    return squeeze(x)


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(T.TOKEN)})"


def keep_sql(x: str, drop=None) -> str:
    return f"list_filter({x}, lambda t: length(t) > 1" + (f" AND NOT list_contains({words(drop)}, t)" if drop else "") + ")"


def stem_sql(t: str, suffixes) -> str:
    whens = " ".join(f"WHEN ends_with({t}, {lit(s)}) AND length({t}) >= {len(s) + 3} THEN substr({t}, 1, length({t}) - {len(s)}) || {lit({'ies': 'y', 'sses': 'ss'}.get(s, ''))}" for s in suffixes)
    return f"CASE WHEN length({t}) <= 3 THEN {t} {whens} ELSE {t} END"


def stems_sql(x: str, suffixes=T.SUFFIXES) -> str:
    return f"list_transform({x}, lambda t: {stem_sql('t', suffixes)})"


def lines_sql(x: str) -> str:
    low = "lower(trim(l, e' \\t\\n\\r\\x0B\\x0C'))"
    stays = " AND ".join([f"{low} <> ''"] + [f"NOT contains({low}, {lit(k)})" for k in C.LINE_KEYWORDS] + [f"NOT starts_with({low}, {lit(k)})" for k in C.LINE_STARTS])
    return f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: {stays}), chr(10))"


def mojibake_sql(x: str) -> str:
    for bad, good in C.MOJIBAKE:
        x = f"replace({x}, {lit(bad)}, {lit(good)})"
    return x


def full_sql(x: str) -> str:
    x = mojibake_sql(lines_sql(f"coalesce({x}, '')"))
    x = gsub(x, C.MARKDOWN_LINK, r"'\1'")
    x = gsub(gsub(x, r"\*+"), C.EMOJI)
    x = f"lower({x})"
    for p in (C.URL, C.TAG, r"#[\p{L}\p{N}_]+", C.SLASH_MENTION, r"[@#][\p{L}\p{N}_]+", r"\d+", C.NON_WORD):
        x = gsub(x, p)
    return squeeze(x)


V2 = f"SELECT doc_id, {keep_sql(tokens_sql(basic_sql('text')), T.STOP_WORDS)} AS tokens FROM documents"
V3 = f"SELECT doc_id, {stems_sql(keep_sql(tokens_sql(basic_sql('text')), T.STOP_WORDS))} AS tokens FROM documents"
FULL_DROP = T.STOP_WORDS + T.CONTRACTION_ENDS + T.NOISE
PREP = f"""
c AS (SELECT doc_id, text, {full_sql('text')} AS clean_text FROM documents),
t AS (SELECT *, {tokens_sql('clean_text')} AS tokens FROM c),
k AS (SELECT *, {keep_sql('tokens', FULL_DROP)} AS kept FROM t),
s AS (SELECT *, {stems_sql('kept', T.SUFFIXES_LONG)} AS stems FROM k),
p AS (SELECT *, stems[1:{T.MAX_TOKENS}] AS stemmed FROM s)"""


def v(spark, sf: str, name: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.variant(F.col("text"), name).alias("tokens"))


def prep(spark, sf: str) -> DataFrame:
    return T.preprocess(docs(spark, sf), "text")


# ---- cleaning and tokens ----


@query("unigram_topk", f"SELECT token, count(*) AS frequency FROM (SELECT unnest(tokens) AS token FROM ({V2})) GROUP BY token ORDER BY frequency DESC, token LIMIT 200")
def _(spark, sf):
    return corpus.unigram_freq(v(spark, sf, "v2_no_stop"))


@query("bigram_topk", f"SELECT bigram, count(*) AS frequency FROM (SELECT unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS bigram FROM ({V2})) GROUP BY bigram ORDER BY frequency DESC, bigram LIMIT 200")
def _(spark, sf):
    return corpus.bigram_freq(v(spark, sf, "v2_no_stop"))


@query("clean_basic", f"SELECT doc_id, {basic_sql('text')} AS clean FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", C.basic_clean(F.col("text")).alias("clean"))


@query("clean_serving", f"SELECT page_id, {basic_sql('html', False)} AS clean FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.serving_clean(F.col("html")).alias("clean"))


@query("clean_html", f"SELECT page_id, {basic_sql('html')} AS clean FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.basic_clean(F.col("html")).alias("clean"))


@query("clean_full", f"SELECT doc_id, {full_sql('text')} AS clean FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", C.full_clean(F.col("text")).alias("clean"))


@query("strip_boilerplate_lines", f"SELECT doc_id, {lines_sql('text')} AS kept FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", C.strip_boilerplate_lines(F.col("text")).alias("kept"))


_PHRASES = " OR ".join(f"contains(lower(s), {lit(p)})" for p in C.SENTENCE_PHRASES)
_SPLIT = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query("drop_boilerplate_sentences", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, {squeeze(f"array_to_string(list_filter(list_transform({_SPLIT}, lambda x: trim(x, e' \\t\\n\\r')), lambda s: s <> '' AND NOT (starts_with(lower(s), 'about ') AND contains(substr(lower(s), 1, 120), ':')) AND NOT ({_PHRASES})), ' ')")} AS kept FROM d)
SELECT doc_id, CASE WHEN len(list_filter(string_split(kept, ' '), lambda w: w <> '')) < 12 THEN text ELSE kept END AS kept FROM o""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", C.drop_boilerplate_sentences(F.col("text")).alias("kept"))


_BROKEN = "".join(bad for bad, _ in C.MOJIBAKE)


@query("mojibake_repair", f"SELECT doc_id, {mojibake_sql(f'concat({lit(_BROKEN)}, text)')} AS repaired FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", C.repair_mojibake(F.concat(F.lit(_BROKEN), C.safe_text(F.col("text")))).alias("repaired"))


for _name, _sql in (("v1_basic", keep_sql(tokens_sql(basic_sql("text")))), ("v2_no_stop", keep_sql(tokens_sql(basic_sql("text")), T.STOP_WORDS)), ("v3_stem", stems_sql(keep_sql(tokens_sql(basic_sql("text")), T.STOP_WORDS)))):

    @query(f"tokens_{_name[:2]}", f"SELECT doc_id, array_to_string({_sql}, ' ') AS tokens FROM documents")
    def _(spark, sf, name=_name):
        return v(spark, sf, name).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("stem_tokens", f"SELECT DISTINCT t AS token, {stem_sql('t', T.SUFFIXES_LONG)} AS stem FROM (SELECT unnest(tokens) AS t FROM ({V2}))")
def _(spark, sf):
    return corpus.each(v(spark, sf, "v2_no_stop"), "tokens", "token").distinct().select("token", T.stem(F.col("token"), T.SUFFIXES_LONG).alias("stem"))


@query("preprocess_lengths", f"WITH {PREP} SELECT doc_id, length(text) AS text_char_len, len(tokens) AS token_count, len(kept) AS token_no_stop_count, len(stemmed) AS stemmed_count, len(stemmed) = 0 AS is_empty, len(stems) > {T.MAX_TOKENS} AS was_truncated FROM p")
def _(spark, sf):
    size = lambda c: F.size(c).cast("long")
    return prep(spark, sf).select("doc_id", F.length("text").cast("long").alias("text_char_len"), size("tokens").alias("token_count"), size("tokens_no_stop").alias("token_no_stop_count"), size("stemmed_tokens").alias("stemmed_count"), (F.size("stemmed_tokens") == 0).alias("is_empty"), F.col("was_truncated_for_analysis").alias("was_truncated"))


@query("final_text", f"WITH {PREP} SELECT doc_id, array_to_string(stemmed, ' ') AS final_text FROM p")
def _(spark, sf):
    return prep(spark, sf).select("doc_id", "final_text")


@query("processed_posts", f"""
WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS selftext FROM documents)
SELECT doc_id, title AS original_title, array_to_string({stems_sql(keep_sql(tokens_sql(full_sql('title')), FULL_DROP), T.SUFFIXES_LONG)}[1:350], ' ') AS title,
       length(selftext) AS selftext_len, array_to_string({stems_sql(keep_sql(tokens_sql(full_sql('selftext')), FULL_DROP), T.SUFFIXES_LONG)}[1:350], ' ') AS selftext FROM d""")
def _(spark, sf):
    d = docs(spark, sf).select("doc_id", F.substring_index("text", "\n", 1).alias("original_title"), F.when(F.contains("text", F.lit("\n")), F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("").alias("original_selftext"))
    out = T.preprocess(T.preprocess(d, "original_title", "title_"), "original_selftext", "selftext_")
    return out.select("doc_id", "original_title", F.col("title_final_text").alias("title"), F.length("original_selftext").cast("long").alias("selftext_len"), F.col("selftext_final_text").alias("selftext"))


# ---- corpus statistics ----
TF = f"WITH d AS ({V3}), n AS (SELECT count(*) AS n FROM d), x AS (SELECT doc_id, len(tokens) AS total, unnest(tokens) AS token FROM d), tf AS (SELECT doc_id, token, total, count(*) AS tf FROM x GROUP BY ALL), df AS (SELECT token, count(*) AS doc_freq FROM tf GROUP BY token), i AS (SELECT token, doc_freq, ln((1 + n) / (1 + doc_freq)) + 1 AS idf FROM df, n), w AS (SELECT doc_id, tf.token, tf, doc_freq, idf, tf / total * idf AS tfidf FROM tf JOIN i USING (token))"


@query("term_freq", f"{TF} SELECT doc_id, token, tf FROM tf")
def _(spark, sf):
    return corpus.term_freq(v(spark, sf, "v3_stem"))


@query("doc_freq_idf", f"{TF} SELECT token, doc_freq, round(idf, 6) AS idf FROM i")
def _(spark, sf):
    return corpus.inverse_df(v(spark, sf, "v3_stem")).withColumn("idf", F.round("idf", 6))


@query("tfidf_scores", f"{TF} SELECT doc_id, token, round(tfidf, 6) AS tfidf FROM w")
def _(spark, sf):
    return corpus.tfidf(v(spark, sf, "v3_stem")).select("doc_id", "token", F.round("tfidf", 6).alias("tfidf"))


@query("tfidf_features", f"{TF} SELECT token, any_value(doc_freq) AS doc_freq, round(any_value(idf), 6) AS idf, round(avg(tfidf), 6) AS mean_tfidf, round(max(tfidf), 6) AS max_tfidf FROM w GROUP BY token ORDER BY round(avg(tfidf), 12) DESC, doc_freq DESC, token LIMIT 200")
def _(spark, sf):
    out = corpus.tfidf_features(v(spark, sf, "v3_stem"))
    return out.select("token", "doc_freq", *[F.round(c, 6).alias(c) for c in ("idf", "mean_tfidf", "max_tfidf")])


@query("top_terms_per_doc", f"{TF}, r AS (SELECT doc_id, token, tfidf, row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 12) DESC, token) AS rank FROM w) SELECT doc_id, rank, token, round(tfidf, 6) AS tfidf FROM r WHERE rank <= 10")
def _(spark, sf):
    return corpus.top_terms(v(spark, sf, "v3_stem")).select("doc_id", F.col("rank").cast("long").alias("rank"), "token", F.round("tfidf", 6).alias("tfidf"))


@query("rendered_top_terms", f"{TF}, r AS (SELECT doc_id, token, tfidf, row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 12) DESC, token) AS rank FROM w), g AS (SELECT doc_id, string_agg(token || ':' || printf('%.4f', tfidf), ' | ' ORDER BY rank) AS t FROM r WHERE rank <= 10 GROUP BY doc_id) SELECT doc_id, coalesce(t, '') AS top_terms FROM documents LEFT JOIN g USING (doc_id)")
def _(spark, sf):
    return corpus.rendered_top_terms(v(spark, sf, "v3_stem"))


@query("corpus_summary", f"""WITH {PREP}, u AS (SELECT count(DISTINCT t) AS unique_unigrams FROM (SELECT unnest(stemmed) AS t FROM p)),
b AS (SELECT count(DISTINCT g) AS unique_bigrams FROM (SELECT unnest(list_transform(range(1, len(stemmed)), lambda i: stemmed[i] || ' ' || stemmed[i + 1])) AS g FROM p))
SELECT count(*) AS n_docs, count(*) FILTER (len(stemmed) = 0) AS n_empty, round(avg(len(tokens)), 6) AS avg_tokens, round(avg(len(kept)), 6) AS avg_tokens_no_stop, round(avg(len(stemmed)), 6) AS avg_stemmed,
any_value(unique_unigrams) AS unique_unigrams, any_value(unique_bigrams) AS unique_bigrams, least(200, any_value(unique_unigrams)) AS exported_unigrams, least(200, any_value(unique_bigrams)) AS exported_bigrams FROM p, u, b""")
def _(spark, sf):
    out = corpus.corpus_summary(prep(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_tokens", "avg_tokens_no_stop", "avg_stemmed")})


VOCAB = f"vocab AS (SELECT token, row_number() OVER (ORDER BY f DESC, token) - 1 AS idx FROM (SELECT token, count(*) AS f FROM (SELECT unnest(tokens) AS token FROM ({V2})) GROUP BY token ORDER BY f DESC, token LIMIT 1200))"


@query("vocab_index", f"WITH {VOCAB} SELECT token, idx FROM vocab")
def _(spark, sf):
    return corpus.vocabulary(v(spark, sf, "v2_no_stop")).withColumn("idx", F.col("idx").cast("long"))


BOW = f"bow AS (SELECT doc_id, idx, count(*) AS cnt FROM (SELECT doc_id, unnest(tokens) AS token FROM ({V2})) JOIN vocab USING (token) GROUP BY ALL)"


@query("bow_counts", f"WITH {VOCAB}, {BOW} SELECT doc_id, idx, cnt FROM bow")
def _(spark, sf):
    d = v(spark, sf, "v2_no_stop")
    return corpus.bow(d)[1].withColumn("idx", F.col("idx").cast("long"))


@query("vocabulary_union", f"SELECT token FROM (SELECT unnest(tokens) AS token FROM ({V2})) UNION SELECT token FROM (SELECT unnest(tokens) AS token FROM ({V3}))")
def _(spark, sf):
    """The stemmed variant's tokens are stems of the other's, so distinct tokens are stemmed, once each."""
    d = corpus.each(v(spark, sf, "v2_no_stop"), "tokens", "token").distinct()
    return corpus.each(d, F.array("token", T.stem(F.col("token"))), "token").distinct()


# ---- lexicons ----
POSITIVE, NEGATIVE, NEG = ["with", "this", "from"], ["that", "than", "then", "this"], ["no", "of"]
TOK = f"SELECT doc_id, {tokens_sql(basic_sql('text'))} AS tokens FROM documents"
SCOPED = f"""tk AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM ({TOK})),
sc AS (SELECT *, max(CASE WHEN token IN {tuple(NEG)} THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM tk),
fl AS (SELECT *, coalesce(pos - last <= 3, false) AS flipped FROM sc WHERE token NOT IN {tuple(NEG)})"""
LABEL_SQL = "CASE WHEN abs(score) < 0.05 THEN 'neutral' WHEN score > 0 THEN 'positive' ELSE 'negative' END"
LEX = f"""WITH {SCOPED}, po AS (SELECT doc_id, CASE WHEN token IN {tuple(POSITIVE)} THEN 1 WHEN token IN {tuple(NEGATIVE)} THEN -1 ELSE 0 END * CASE WHEN flipped THEN -1 ELSE 1 END AS p FROM fl),
ag AS (SELECT doc_id, count(*) FILTER (p > 0) AS pos, count(*) FILTER (p < 0) AS neg FROM po GROUP BY doc_id),
lx AS (SELECT d.doc_id, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce((pos - neg) / nullif(pos + neg, 0), 0.0) AS score FROM documents d LEFT JOIN ag USING (doc_id)),
lp AS (SELECT *, {LABEL_SQL} AS label FROM lx)"""


def toks(spark, sf):
    return docs(spark, sf).select("doc_id", T.tokenize(C.basic_clean(F.col("text"))).alias("tokens"))


def small_lexicon(spark):
    return spark.createDataFrame([(w, 1) for w in POSITIVE] + [(w, -1) for w in NEGATIVE], "word string, polarity int")


@query("lexicon_join", f"{LEX} SELECT doc_id, pos, neg, round(score, 6) AS score, label FROM lp")
def _(spark, sf):
    return lexicon.lexicon_predict(toks(spark, sf), small_lexicon(spark), negators=NEG).withColumn("score", F.round("score", 6))


@query("lexicon_negation", f"{LEX} SELECT doc_id, pos, neg, label FROM lp")
def _(spark, sf):
    polarity = lambda t: F.when(t.isin(POSITIVE), 1).when(t.isin(NEGATIVE), -1).otherwise(0)
    r = toks(spark, sf).select("doc_id", lexicon.scored_fold(F.col("tokens"), polarity, NEG).alias("r"))
    return r.select("doc_id", F.col("r.pos").cast("long").alias("pos"), F.col("r.neg").cast("long").alias("neg"), S.margin_label(lexicon.ratio(F.col("r.pos"), F.col("r.neg"))).alias("label"))


SYNSETS = [("with", 1, 0.5, 0.0), ("with", 2, 0.25, 0.125), ("that", 1, 0.0, 0.625), ("that", 2, 0.0, 0.25), ("that", 3, 0.125, 0.0), ("that", 4, 1.0, 0.0), ("from", 1, 0.375, 0.0)]


@query("synset_score", f"""WITH {SCOPED}, sy(lemma, rank, ps, ns) AS (VALUES {', '.join(str(s) for s in SYNSETS)}),
per AS (SELECT lemma, avg(ps - ns) AS s FROM sy WHERE rank <= 3 GROUP BY lemma),
m AS (SELECT doc_id, avg(CASE WHEN flipped THEN -s ELSE s END) AS score FROM fl JOIN per ON token = lemma GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(score, 0.0) AS score FROM documents d LEFT JOIN m USING (doc_id))
SELECT doc_id, round(score, 6) AS score, {LABEL_SQL} AS label FROM r""")
def _(spark, sf):
    sy = spark.createDataFrame(SYNSETS, "lemma string, rank int, pos_score double, neg_score double")
    return lexicon.synset_predict(toks(spark, sf), sy, negators=NEG).withColumn("score", F.round("score", 6))



# ---- labels, agreement, evaluation ----
TRUTH = "CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END"


def truth(spark, sf):
    return table(spark, sf, "labels").select("doc_id", "quality", "toxic", F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral").alias("label"))


@query("label_normalize", f"WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' POSitive! ' WHEN doc_id % 5 = 1 THEN 'neg' WHEN doc_id % 5 = 2 THEN '' WHEN doc_id % 5 = 3 THEN NULL ELSE {TRUTH} END AS raw FROM labels) SELECT doc_id, CASE WHEN contains(lower(coalesce(raw, '')), 'pos') THEN 'positive' WHEN contains(lower(coalesce(raw, '')), 'neg') THEN 'negative' ELSE 'neutral' END AS label FROM r")
def _(spark, sf):
    m = F.col("doc_id") % 5
    raw = F.when(m == 0, " POSitive! ").when(m == 1, "neg").when(m == 2, "").when(m == 3, F.lit(None)).otherwise(F.col("label"))
    return truth(spark, sf).select("doc_id", S.normalize_label(raw).alias("label"))


@query("threshold_label", "SELECT event_id, CASE WHEN (value - 50) / 1000 >= 0.05 THEN 'positive' WHEN (value - 50) / 1000 <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", S.threshold_label((F.col("value") - 50) / 1000).alias("label"))


RATERS = f"ra AS (SELECT doc_id, {TRUTH} AS r1, CASE WHEN doc_id % 4 = 0 THEN 'neutral' ELSE {TRUTH} END AS r2, CASE WHEN doc_id % 3 = 0 THEN 'negative' ELSE {TRUTH} END AS r3 FROM labels)"
VOTE = "CASE WHEN r1 = r2 OR r1 = r3 THEN r1 WHEN r2 = r3 THEN r2 ELSE 'neutral' END"


def raters(spark, sf):
    t = truth(spark, sf)
    return t.select("doc_id", F.col("label").alias("r1"), F.when(F.col("doc_id") % 4 == 0, "neutral").otherwise(F.col("label")).alias("r2"), F.when(F.col("doc_id") % 3 == 0, "negative").otherwise(F.col("label")).alias("r3"))


@query("majority_vote", f"WITH {RATERS} SELECT doc_id, r1, r2, r3, {VOTE} AS final_label FROM ra")
def _(spark, sf):
    return raters(spark, sf).withColumn("final_label", evaluate.majority_vote(F.col("r1"), F.col("r2"), F.col("r3")))


@query("fleiss_kappa", f"""WITH {RATERS}, c AS (SELECT (r1 = 'positive')::INT + (r2 = 'positive')::INT + (r3 = 'positive')::INT AS a, (r1 = 'neutral')::INT + (r2 = 'neutral')::INT + (r3 = 'neutral')::INT AS b, (r1 = 'negative')::INT + (r2 = 'negative')::INT + (r3 = 'negative')::INT AS c FROM ra),
g AS (SELECT count(*) AS n_items, avg((a * a + b * b + c * c - 3) / 6.0) AS p_bar, pow(sum(a) / (3.0 * count(*)), 2) + pow(sum(b) / (3.0 * count(*)), 2) + pow(sum(c) / (3.0 * count(*)), 2) AS p_e FROM c)
SELECT n_items, round(p_bar, 6) AS p_bar, round(p_e, 6) AS p_e, round((p_bar - p_e) / (1 - p_e), 6) AS kappa FROM g""")
def _(spark, sf):
    return evaluate.fleiss_kappa(raters(spark, sf), ["r1", "r2", "r3"]).select("n_items", *[F.round(c, 6).alias(c) for c in ("p_bar", "p_e", "kappa")])


#: Labels up to which they are broadcast to the texts.
LABELS = 2_000_000


def predicted(spark, sf):
    """Predictions of the labelled texts; the others have no label to be held against."""
    d = toks(spark, sf).join(lexicon._dimension(truth(spark, sf).select("doc_id"), LABELS), "doc_id", "left_semi")
    lex = lexicon.lexicon_predict(d, small_lexicon(spark), negators=NEG)
    return truth(spark, sf).select("doc_id", F.col("label").alias("true_label")).join(lex.select("doc_id", F.col("label").alias("pred_label")), "doc_id")


def with_texts(spark, sf, rows):
    """rows(doc_id, ...) with their texts: the rows, being short, go to the texts."""
    return docs(spark, sf).join(lexicon._dimension(written(rows), LABELS), "doc_id")


PREDICTED = f"{LEX}, pr AS (SELECT doc_id, {TRUTH} AS true_label, label AS pred_label FROM labels JOIN lp USING (doc_id))"
GRID = "lb(l) AS (VALUES ('negative'), ('neutral'), ('positive')), cm AS (SELECT a.l AS true_label, b.l AS pred_label, count(doc_id) AS n FROM lb a CROSS JOIN lb b LEFT JOIN pr ON pr.true_label = a.l AND pr.pred_label = b.l GROUP BY ALL)"
CLASSES = "pc AS (SELECT l AS label, coalesce(sum(n) FILTER (true_label = l AND pred_label = l), 0) AS tp, coalesce(sum(n) FILTER (true_label = l), 0) AS support, coalesce(sum(n) FILTER (pred_label = l), 0) AS predicted FROM lb, cm GROUP BY l), pm AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM pc), pf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pm)"


@query("confusion_matrix", f"{PREDICTED}, {GRID} SELECT * FROM cm")
def _(spark, sf):
    return evaluate.confusion(predicted(spark, sf), "true_label", "pred_label")


@query("class_metrics", f"{PREDICTED}, {GRID}, {CLASSES} SELECT label, support::BIGINT AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pf")
def _(spark, sf):
    out = evaluate.per_class(evaluate.confusion(predicted(spark, sf), "true_label", "pred_label"))
    return out.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("metrics", f"{PREDICTED}, {GRID}, {CLASSES} SELECT round(sum(tp) / sum(support), 6) AS accuracy, " + ", ".join(f"round(sum({m}) / 3, 6) AS macro_{m}, round(sum({m} * support) / sum(support), 6) AS weighted_{m}" for m in ("precision", "recall", "f1")) + " FROM pf")
def _(spark, sf):
    out = evaluate.metrics(evaluate.confusion(predicted(spark, sf), "true_label", "pred_label"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("confusion_pairs", f"{PREDICTED} SELECT true_label, pred_label, count(*) AS n FROM pr WHERE true_label <> pred_label GROUP BY ALL ORDER BY n DESC, true_label, pred_label LIMIT 10")
def _(spark, sf):
    return evaluate.confusion_pairs(predicted(spark, sf), "true_label", "pred_label")


@query("error_patterns", f"""{PREDICTED}, ms AS (SELECT doc_id, {basic_sql('text', False)} AS t FROM pr JOIN documents USING (doc_id) WHERE true_label <> pred_label),
mt AS (SELECT list_filter(string_split(t, ' '), lambda w: w <> '') AS w FROM ms),
cut AS (SELECT greatest(6, floor(quantile_cont(len(w), 0.25)))::BIGINT AS cut FROM mt)
SELECT any_value(cut) AS short_text_threshold_tokens, count(*) AS n_misclassified, round(avg((len(w) <= cut)::INT), 6) AS pct_short, round(avg(list_has_any(w, {words(evaluate.NEGATION_WORDS)})::INT), 6) AS pct_has_negation FROM mt, cut""")
def _(spark, sf):
    wrong = with_texts(spark, sf, evaluate.misclassified(predicted(spark, sf), "true_label", "pred_label"))
    out = evaluate.error_patterns(wrong.withColumn("clean_text", C.serving_clean(F.col("text"))))
    return out.select("short_text_threshold_tokens", "n_misclassified", *[F.round(c, 6).alias(c) for c in ("pct_short", "pct_has_negation")])


@query("misclassified", f"{PREDICTED} SELECT doc_id, true_label, pred_label, substr(text, 1, 400) AS text FROM pr JOIN documents USING (doc_id) WHERE true_label <> pred_label")
def _(spark, sf):
    wrong = with_texts(spark, sf, evaluate.misclassified(predicted(spark, sf), "true_label", "pred_label"))
    return evaluate.misclassified(wrong, "true_label", "pred_label", {"text": 400}).select("doc_id", "true_label", "pred_label", "text")


@query("label_distribution", f"SELECT {TRUTH} AS label, count(*) AS n FROM labels GROUP BY ALL")
def _(spark, sf):
    return truth(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


# ---- sampling and splits ----
HASH = "md5(concat_ws(':', '42', doc_id::VARCHAR))"


@query("sample_n", f"SELECT doc_id FROM documents ORDER BY {HASH}, doc_id LIMIT 200")
def _(spark, sf):
    return sampling.sample_n(docs(spark, sf), 200).select("doc_id")


RANKED = f"WITH t AS (SELECT doc_id, {TRUTH} AS label FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH}, doc_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM t)"


@query("stratified_split", f"{RANKED} SELECT doc_id, label, CASE WHEN k <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' ELSE 'train' END AS split FROM r")
def _(spark, sf):
    return sampling.stratified_split(truth(spark, sf), "label").select("doc_id", "label", "split")


@query("stratified_folds", f"{RANKED} SELECT doc_id, label, (k % 3)::INT AS fold FROM r")
def _(spark, sf):
    t = truth(spark, sf)
    return sampling.stratified_folds(t, "label", sampling.fold_count(t, "label")).select("doc_id", "label", "fold")


@query("random_baseline", f"SELECT doc_id, CASE ('0x' || substr({HASH}, 1, 8))::BIGINT % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS pred FROM labels")
def _(spark, sf):
    return sampling.random_labels(truth(spark, sf)).select("doc_id", "pred")


# ---- naive Bayes ----
NB = f"""WITH {VOCAB}, {BOW}, tr AS (SELECT doc_id, {TRUTH} AS label FROM labels), pri AS (SELECT label, ln(count(*) / (SELECT count(*) FROM tr)) AS log_prior FROM tr GROUP BY label),
su AS (SELECT label, idx, sum(cnt) AS c FROM bow JOIN tr USING (doc_id) GROUP BY ALL),
fu AS (SELECT label, log_prior, idx, coalesce(c, 0) + 1.0 AS c FROM pri CROSS JOIN (SELECT idx FROM vocab) LEFT JOIN su USING (label, idx)),
mo AS (SELECT label, idx, log_prior, ln(c / sum(c) OVER (PARTITION BY label)) AS log_prob FROM fu)"""


def nb(spark, sf):
    d = v(spark, sf, "v2_no_stop")
    vocab, counts = corpus.bow(d)
    return d, counts, bayes.multinomial_fit(counts, truth(spark, sf).select("doc_id", "label"), vocab)


@query("multinomial_nb_params", f"{NB} SELECT label, idx, round(log_prior, 6) AS log_prior, round(log_prob, 6) AS log_prob FROM mo")
def _(spark, sf):
    return nb(spark, sf)[2].select("label", F.col("idx").cast("long").alias("idx"), F.round("log_prior", 6).alias("log_prior"), F.round("log_prob", 6).alias("log_prob"))


@query("multinomial_nb_predict", f"""{NB}, sx AS (SELECT doc_id, label, sum(cnt * log_prob) AS s FROM bow JOIN mo USING (idx) GROUP BY ALL),
sc AS (SELECT d.doc_id, p.label, log_prior + coalesce(s, 0) AS score FROM documents d CROSS JOIN pri p LEFT JOIN sx ON sx.doc_id = d.doc_id AND sx.label = p.label)
SELECT doc_id, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, label) AS k FROM sc) WHERE k = 1""")
def _(spark, sf):
    d, counts, model = nb(spark, sf)
    return bayes.multinomial_predict(counts, d, model)


GNB = """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
g AS (SELECT label, i, avg(x) AS mean, var_pop(x) + 1e-8 AS var, count(*) AS n FROM x GROUP BY ALL),
m AS (SELECT label, i, mean, var, ln(n / sum(n) OVER (PARTITION BY i) + 1e-12) AS log_prior FROM g)"""


@query("gaussian_nb_params", f"{GNB} SELECT label, i::INT AS i, round(mean, 6) AS mean, round(var, 6) AS var, round(log_prior, 6) AS log_prior FROM m")
def _(spark, sf):
    m = bayes.gaussian_fit(table(spark, sf, "embeddings"), "embedding")
    return m.select("label", "i", *[F.round(c, 6).alias(c) for c in ("mean", "var", "log_prior")])


@query("gaussian_nb_predict", f"""{GNB}, y AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
s AS (SELECT vec_id, label, round(any_value(log_prior) + sum(-0.5 * (1.8378770664093453 + ln(var) + (x - mean) * (x - mean) / var)), 6) AS s FROM y JOIN m USING (i) GROUP BY ALL)
SELECT vec_id, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM s) WHERE k = 1""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    return bayes.gaussian_predict(e, bayes.gaussian_fit(e, "embedding"), "vec_id", "embedding")


@query("embedding_average", f"""WITH e AS (SELECT token, embedding FROM (SELECT token, idx FROM (WITH {VOCAB} SELECT * FROM vocab)) JOIN embeddings ON idx = vec_id),
x AS (SELECT doc_id, unnest(tokens) AS token FROM ({V2})), h AS (SELECT doc_id, embedding FROM x JOIN e USING (token)),
p AS (SELECT doc_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM h), a AS (SELECT doc_id, i, avg(v) AS m FROM p GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(m * m)) AS norm, max(m) FILTER (i = 1) AS first FROM a GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(norm, 0), 5) AS norm, round(coalesce(first, 0), 5) AS first FROM documents d LEFT JOIN n USING (doc_id)""")
def _(spark, sf):
    d = v(spark, sf, "v2_no_stop")
    vectors = corpus.vocabulary(d).join(table(spark, sf, "embeddings"), F.col("idx") == F.col("vec_id")).select(F.col("token").alias("word"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    out = corpus.embedding_average(d, vectors, 64)
    return out.select("doc_id", F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), 5).alias("norm"), F.round(F.col("vec")[0], 5).alias("first"))


# ---- collection ----
TERMS = ["the", "with", "para", "nicht", "pathetic"]


@query("term_search_topk", f"WITH t(term) AS (VALUES {', '.join(f'({lit(t)})' for t in TERMS)}), h AS (SELECT term, doc_id, n_chars AS score, row_number() OVER (PARTITION BY term ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN t ON contains(lower(text), term)) SELECT term, doc_id, score, rank FROM h WHERE rank <= 100")
def _(spark, sf):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    out = collect.search_terms(table(spark, sf, "documents").withColumn("score", F.col("n_chars")), terms)
    return out.select("term", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("search_fallback", "SELECT doc_id AS post_id, n_chars::BIGINT AS score FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(lang), 'the')) AND lower(source) IN ('src1', 'src2', 'src3') ORDER BY score DESC, post_id LIMIT 100")
def _(spark, sf):
    posts = table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), F.col("source").alias("subreddit"), F.col("lang").alias("title"), F.col("text").alias("selftext"), F.lit(None).cast("string").alias("search_query"), F.col("n_chars").cast("string").alias("score"))
    return collect.search_fallback(posts, "THE", 100, ["SRC1", "src2", "Src3"]).select("post_id", "score")


def posts(spark, sf):
    d = table(spark, sf, "documents")
    first = F.substring_index("text", "\n", 1)
    return d.select(F.col("doc_id").alias("post_id"), F.col("source").alias("subreddit"), F.when(F.col("lang") == "en", "the").otherwise("que").alias("term"), F.concat(F.lit(" "), first).alias("title"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("selftext"), F.col("n_chars").cast("string").alias("score"), F.lit("12.0").alias("num_comments"), (F.col("doc_id") * 3607.5 + 1700000000).alias("created_utc"))


@query("post_enrichment", """
WITH p AS (SELECT doc_id AS post_id, source AS subreddit, CASE WHEN lang = 'en' THEN 'the' ELSE 'que' END AS term, trim(split_part(text, chr(10), 1), e' \\t\\r') AS title,
  trim(CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END, e' \\t\\r\\n') AS selftext, n_chars AS score, make_timestamp(((doc_id * 3607.5 + 1700000000) * 1000000)::BIGINT) AS ts FROM documents)
SELECT post_id, subreddit, term, title, score, 0::BIGINT AS num_comments, score AS engagement, strftime(ts, '%A') AS created_day_of_week_utc, hour(ts)::INT AS created_hour_utc,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS created_datetime_utc,
  length(title)::INT AS title_char_len, length(selftext)::INT AS selftext_char_len, length(trim(title || ' ' || selftext))::INT AS text_char_len, length(selftext) > 0 AS has_selftext,
  contains(lower(title), term) AS term_in_title, contains(lower(selftext), term) AS term_in_selftext FROM p""")
def _(spark, sf):
    return collect.enrich(posts(spark, sf)).select("post_id", "subreddit", "term", "title", "score", "num_comments", "engagement", "created_day_of_week_utc", "created_hour_utc", "created_datetime_utc", "title_char_len", "selftext_char_len", "text_char_len", "has_selftext", "term_in_title", "term_in_selftext")


@query("term_news", "WITH n AS (SELECT lang AS term, n_chars, text, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS article_rank FROM documents) SELECT term, count(*) AS news_count_for_term, string_agg(md5(text), ',' ORDER BY article_rank) AS titles FROM n WHERE article_rank <= 5 GROUP BY term")
def _(spark, sf):
    news = table(spark, sf, "documents").select(F.col("lang").alias("term"), F.md5(F.encode("text", "UTF-8")).alias("title"), F.col("n_chars").alias("relevance"), F.col("doc_id").alias("url"))
    ranked = collect.news_for_terms(news, 5)
    per = ranked.groupBy("term").agg(F.count("*").alias("news_count_for_term"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_rank", "title"))), lambda s: s["title"]), ",").alias("titles"))
    return per


@query("keep_first_dedup", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC NULLS LAST, ts DESC NULLS LAST, event_id) AS k FROM events) WHERE k = 1")
def _(spark, sf):
    order = [F.desc_nulls_last("value"), F.desc_nulls_last("ts"), "event_id"]
    return collect.first_seen(table(spark, sf, "events"), ["event_type", "user_id"], order).select("event_id", "user_id", "event_type")


@query("first_seen_dedup", "WITH p AS (SELECT *, event_id % 3 AS so FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY event_type, so ORDER BY ts, event_id) AS r FROM p) SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY so, ts, event_id) AS f FROM k WHERE r <= 33) WHERE f = 1")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.lit("all").alias("term"), F.col("event_type").alias("subreddit"), (F.col("event_id") % 3).alias("sort_order"), F.struct("ts", "event_id").alias("position"), F.col("user_id").alias("post_id"))
    return collect.search_posts(e, 100, 3).select("event_id")


def enriched(spark, sf):
    e = table(spark, sf, "events")
    c = (F.col("value") - 50) / 100
    return e.select(F.col("event_type").alias("term"), (F.length("event_type")).alias("trend_rank"), F.col("event_id").alias("post_id"), F.col("user_id").alias("subreddit"), F.col("value").alias("engagement"), c.alias("compound"), S.threshold_label(c).alias("sentiment_label"))


@query("term_summary", "WITH e AS (SELECT *, (value - 50) / 100 AS c FROM events) SELECT event_type AS term, min(length(event_type))::INT AS trend_rank, count(event_id) AS posts, count(DISTINCT user_id) AS subreddits, round(avg(c), 6) AS avg_compound, round(avg(value), 6) AS avg_engagement, round(median(value), 6) AS median_engagement, count(*) FILTER (c >= 0.05) AS positive_posts, count(*) FILTER (c > -0.05 AND c < 0.05) AS neutral_posts, count(*) FILTER (c <= -0.05) AS negative_posts FROM e GROUP BY ALL")
def _(spark, sf):
    out = collect.term_summary(enriched(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_compound", "avg_engagement", "median_engagement")})


@query("subreddit_summary", "SELECT user_id AS subreddit, count(event_id) AS posts, count(DISTINCT event_type) AS terms, round(avg((value - 50) / 100), 9) AS avg_compound, round(avg(value), 9) AS avg_engagement, round(median(value), 9) AS median_engagement FROM events GROUP BY ALL")
def _(spark, sf):
    out = collect.subreddit_summary(enriched(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("avg_compound", "avg_engagement", "median_engagement")})


@query("trend_terms", "SELECT source AS trend_term, row_number() OVER (ORDER BY n DESC, source) AS trend_rank, 'US' AS geo FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) ORDER BY n DESC, source LIMIT 10")
def _(spark, sf):
    ranked = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    c = ranked.select(F.lit(1).alias("region_order"), F.lit("US").alias("geo"), F.struct((-F.col("n")).alias("n"), "source").alias("position"), F.col("source").alias("term"))
    none = c.withColumns({"region_order": F.lit(0), "geo": F.lit("GLOBAL"), "term": F.lit(None).cast("string")})
    return collect.trend_terms(none.unionByName(c))


# ---- store, cache, confidences ----
@query("schema_evolving_union", "SELECT o_orderkey AS id, o_totalprice AS amount, o_orderstatus AS status, NULL::VARCHAR AS name, 'run1' AS source_run_id FROM orders UNION ALL SELECT c_custkey, c_acctbal, NULL, c_name, 'run2' FROM customer")
def _(spark, sf):
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_name").alias("name"))
    return io.align(io.stamped(old, "run1", ""), io.stamped(new, "run2", "")).drop("ingested_at_utc")


KEYS = " UNION ALL ".join(f"SELECT conv_id, turn, {i}::INT AS prompt_no, sha256('none::m::' || {lit(p.split('{text}')[0])} || substr(text, 1, 2500) || {lit(p.split('{text}')[1])}) AS cache_key FROM conversations" for i, p in enumerate(S.PROMPTS, 1))


@query("label_cache_lookup", f"WITH k AS ({KEYS}) SELECT conv_id, turn, prompt_no, cache_key, CASE WHEN conv_id % 2 = 0 THEN 'positive' END AS label FROM k")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    keys = labeling.prompt_keys(c, "none", "m", key="key").select("key.*", "prompt_no", "cache_key")
    cache = keys.where("conv_id % 2 = 0").select("cache_key", F.lit("positive").alias("label")).distinct()
    hits, misses = labeling.cached(keys, cache)
    odd = hits.where("conv_id % 2 = 1").withColumn("label", F.lit(None).cast("string"))  # the same text in another conversation
    cols = ["conv_id", "turn", "prompt_no", "cache_key", "label"]
    return hits.where("conv_id % 2 = 0").select(cols).unionByName(odd.select(cols)).unionByName(misses.withColumn("label", F.lit(None).cast("string")).select(cols))


@query("confidences", "SELECT vec_id, round(1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS softmax, round(greatest(1 / (1 + exp(-embedding[1]::DOUBLE)), 1 - 1 / (1 + exp(-embedding[1]::DOUBLE))), 6) AS binary_confidence FROM embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("x", F.transform("embedding", lambda x: x.cast("double")))
    return e.select("vec_id", F.round(S.softmax_confidence(F.col("x")), 6).alias("softmax"), F.round(S.binary_confidence(F.col("x")[0]), 6).alias("binary_confidence"))
