"""Corpus statistics, lexicons, evaluation, sampling, collection and store on small rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import bayes, collect, corpus, evaluate, labeling, lexicon, sampling
from textloom.sources import io

DOCS = [(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, [])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, tokens array<string>")


def test_ngrams(docs):
    assert [tuple(r) for r in corpus.unigram_freq(docs).collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert [tuple(r) for r in corpus.bigram_freq(docs).collect()] == [("a b", 1), ("b a", 1), ("b c", 1)]
    assert corpus.unigram_freq(docs, k=0).count() == 0


def test_tfidf_matches_its_formula(docs):
    got = {(r.doc_id, r.token): r.tfidf for r in corpus.tfidf(docs).collect()}
    idf = lambda df: math.log(4 / (1 + df)) + 1
    want = {(1, "a"): 2 / 3 * idf(1), (1, "b"): 1 / 3 * idf(2), (2, "b"): 1 / 2 * idf(2), (2, "c"): 1 / 2 * idf(1)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert corpus.tfidf_features(docs, k=0).count() == 3
    rows = {r.doc_id: r.top_terms for r in corpus.rendered_top_terms(docs).collect()}
    assert rows[3] == "" and rows[1].startswith("a:1.1288 | b:")


def test_tfidf_weights_keep_every_term(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, []), (4, ["c", "d"])], "doc_id long, tokens array<string>")
    got = {(r.doc_id, r.token): r.weight for r in corpus.tfidf_weights(df).collect()}
    idf = lambda df: math.log(5 / (1 + df)) + 1
    assert got.keys() == {(1, "a"), (1, "b"), (2, "b"), (2, "c"), (4, "c"), (4, "d")}
    assert got[1, "a"] == pytest.approx(2 * idf(1) / math.hypot(2 * idf(1), idf(2)))
    assert {(r.doc_id, r.token) for r in corpus.tfidf_weights(df, min_df=2).collect()} == {(1, "b"), (2, "b"), (2, "c"), (4, "c")}
    many = spark.range(70_000).select(F.col("id").alias("doc_id"), F.array(F.concat(F.lit("t"), "id")).alias("tokens"))
    assert corpus.tfidf_weights(many).count() == 70_000  # more than the models' features


def test_each_evaluates_its_array_once(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.split(F.concat(F.lit("x y"), "id"), "y").alias("tokens"))
    for out in (corpus.unigram_freq(df, k=None), corpus.bigram_freq(df, k=None), corpus.term_freq(df)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted(tuple(r) for r in corpus.unigram_freq(df, k=None).collect()) == [("0", 1), ("1", 1), ("2", 1), ("x ", 3)]


def test_vocabulary_and_bow(docs):
    vocab = corpus.vocabulary(docs, max_features=2)
    assert [tuple(r) for r in vocab.orderBy("idx").collect()] == [("a", 0), ("b", 1)]
    assert sorted(tuple(r) for r in corpus.bow_counts(docs, vocab).collect()) == [(1, 0, 2), (1, 1, 1), (2, 1, 1)]


def test_embedding_average(spark, docs):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "word string, vec array<double>")
    rows = {r.doc_id: r.vec for r in corpus.embedding_average(docs, v, 2).collect()}
    assert rows[1] == pytest.approx([2 / 3, 1.0]) and rows[2] == [0.0, 3.0] and rows[3] == [0.0, 0.0]


def test_empty_corpus(spark):
    e = spark.createDataFrame([], "doc_id long, tokens array<string>")
    assert corpus.tfidf_features(e).count() == 0 and corpus.rendered_top_terms(e).count() == 0


def restated_fold(tokens, pos, neg, negators):
    p = n = left = 0
    for t in tokens:
        if t in negators:
            left = 3
            continue
        v = 1 if t in pos else -1 if t in neg else 0
        v = -v if left else v
        p, n, left = p + (v > 0), n + (v < 0), max(0, left - 1)
    return p, n


def test_fold_equals_window_form(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice(["good", "bad", "not", "x", "y"]) for _ in range(rng.randrange(0, 25))]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    lex = spark.createDataFrame([("good", 1), ("bad", -1), ("x", -1), ("x", 1)], "word string, polarity int")
    joined = {r.doc_id: (r.pos, r.neg) for r in lexicon.lexicon_predict(df, lex).collect()}
    polarity = lambda t: F.when(t.isin("good", "x"), 1).when(t == "bad", -1).otherwise(0)
    folded = {r.doc_id: (r.r.pos, r.r.neg) for r in df.select("doc_id", lexicon.scored_fold(F.col("tokens"), polarity).alias("r")).collect()}
    want = {i: restated_fold(t, {"good", "x"}, {"bad"}, set(lexicon.NEGATORS)) for i, t in rows}
    assert joined == want and folded == want


def test_synsets(spark):
    df = spark.createDataFrame([(1, ["not", "good", "zz"]), (2, ["zz"]), (3, None)], "doc_id long, tokens array<string>")
    sy = spark.createDataFrame([("good", 1, 0.75, 0.0), ("good", 2, 0.25, 0.0), ("good", 9, 0.0, 1.0)], "lemma string, rank int, pos_score double, neg_score double")
    assert {r.doc_id: (r.score, r.label) for r in lexicon.synset_predict(df, sy).collect()} == {1: (-0.5, "negative"), 2: (0.0, "neutral"), 3: (0.0, "neutral")}


def test_polarity_scores(spark):
    df = spark.createDataFrame([(1, ""), (2, "good"), (3, "not good"), (4, "very good"), (5, None)], "doc_id long, text string")
    v = spark.createDataFrame([("good", 1.9)], "word string, valence double")
    r = {x.doc_id: x for x in lexicon.polarity_scores(df, v).collect()}
    assert (r[1].neu, r[1].compound) == (1.0, 0.0) == (r[5].neu, r[5].compound)
    assert r[2].compound == pytest.approx(1.9 / math.sqrt(1.9**2 + 15)) and r[3].compound < 0 < r[2].compound < r[4].compound


def test_majority_vote(spark):
    rows = [("positive", "positive", "negative"), ("positive", "neutral", "negative"), ("negative",) * 3, ("neutral", "negative", "neutral")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert [r.v for r in df.select(evaluate.majority_vote(F.col("a"), F.col("b"), F.col("c")).alias("v")).collect()] == ["positive", "neutral", "negative", "neutral"]


def test_fleiss_kappa(spark):
    df = spark.createDataFrame([("positive", "positive", "positive"), ("negative", "negative", "negative")], "a string, b string, c string")
    assert evaluate.fleiss_kappa(df, ["a", "b", "c"]).first().kappa == pytest.approx(1.0)
    assert evaluate.fleiss_kappa(df.limit(1), ["a", "b", "c"]).first().kappa == 0.0
    assert evaluate.fleiss_kappa(df.limit(0), ["a", "b", "c"]).first().kappa == 0.0
    assert evaluate.fleiss_kappa(df, ["a"]).first().kappa == 0.0


def test_metrics(spark):
    rows = [("positive", "positive"), ("positive", "neutral"), ("negative", "negative"), ("odd", "neutral")]
    cm = evaluate.confusion(spark.createDataFrame(rows, "t string, p string"), "t", "p")
    assert cm.count() == 9
    m = evaluate.metrics(cm).first()
    assert m.accuracy == 0.75 and m.macro_f1 == pytest.approx((2 / 3 + 1 + 2 / 3) / 3) and m.weighted_recall == 0.75


def test_error_patterns_without_errors(spark):
    r = evaluate.error_patterns(spark.createDataFrame([], "clean_text string")).first()
    assert (r.n_misclassified, r.short_text_threshold_tokens, r.pct_short) == (0, 6, 0.0)
    assert evaluate.conclusion(r.asDict(), []).endswith("There are no errors.")


def test_acceptance():
    assert evaluate.accepted(0.5, 0.4) and not evaluate.accepted(float("nan"), 0.1) and not evaluate.accepted(0.3, 0.3) and not evaluate.accepted(None, 0.1)


def test_split_and_folds(spark):
    df = spark.createDataFrame([(i, "a" if i < 30 else "b" if i < 35 else "c") for i in range(36)], "doc_id long, label string")
    split = {r.doc_id: (r.label, r.split) for r in sampling.stratified_split(df, "label").collect()}
    assert len(split) == 36
    assert Counter(v for v in split.values() if v[1] == "test") == {("a", "test"): 6, ("b", "test"): 1, ("c", "test"): 1}
    assert sampling.fold_count(df, "label") == 2
    folds = Counter((r.label, r.fold) for r in sampling.stratified_folds(df, "label", 2).collect())
    assert folds["a", 0] == folds["a", 1] == 15
    assert sampling.sample_n(df, 100).count() == 36 and sampling.sample_n(df, 5).count() == 5


def test_multinomial_nb_against_a_restatement(spark):
    counts = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (2, 1, 3), (3, 0, 1)], "doc_id long, idx int, cnt long")
    labels = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "doc_id long, label string")
    vocab = spark.createDataFrame([(0,), (1,)], "idx int")
    m = {(r.label, r.idx): (r.log_prior, r.log_prob) for r in bayes.multinomial_fit(counts, labels, vocab).collect()}
    assert m["x", 0] == pytest.approx((math.log(2 / 3), math.log(4 / 6))) and m["y", 0] == pytest.approx((math.log(1 / 3), math.log(1 / 5)))
    out = bayes.multinomial_predict(counts, labels, bayes.multinomial_fit(counts, labels, vocab))
    assert {r.doc_id: r.pred for r in out.collect()} == {1: "x", 2: "y", 3: "x"}


def test_collection(spark):
    posts = spark.createDataFrame([("t", "s", 1, 0, "p1"), ("t", "s", 0, 0, "p2"), ("t", "s", 1, 1, "p2"), (None, None, 0, 0, None), (None, None, 1, 0, None)], "term string, subreddit string, sort_order int, position int, post_id string")
    assert sorted(str((r.post_id, r.sort_order)) for r in collect.search_posts(posts, 9, 3).collect()) == ["('p1', 1)", "('p2', 0)", "(None, 0)"]
    none = spark.createDataFrame([], "region_order int, geo string, position int, term string")
    assert [r.trend_rank for r in collect.trend_terms(none, 3).collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        collect.trend_terms(none, strict=True)


def test_store_evolves(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    one = spark.createDataFrame([(1, "x")], "id long, a string")
    two = spark.createDataFrame([(2, 0.5)], "id long, b double")
    assert io.append_to_store({"d": one}, "r1", "now", at)["d"] == {"existing_rows": 0, "incoming_rows": 1, "final_rows": 1, "columns_count": 4}
    stats = io.append_to_store({"d": two}, "r2", "now", at)
    assert stats["d"] == {"existing_rows": 1, "incoming_rows": 1, "final_rows": 2, "columns_count": 5} and io.run_totals(stats) == 2


def test_files(spark, tmp_path):
    schema = "id long, text string"
    at = f"file://{tmp_path}/c"
    assert io.read_csv_or_empty(spark, at, schema).count() == 0
    io.write_csv(spark.createDataFrame([(1, 'a "q"\nb')], schema), at)
    assert io.read_csv_or_empty(spark, at, schema).first().text == 'a "q"\nb'
    io.write_json(spark, {"a": "é"}, f"file://{tmp_path}/r.json")
    assert io.read_json(spark, f"file://{tmp_path}/r.json") == {"a": "é"} and io.read_json(spark, f"file://{tmp_path}/none.json") is None
    (tmp_path / "w.txt").write_text("; c\n\n Good \ngood\nbad\n")
    assert sorted(r.word for r in io.word_list(spark, f"file://{tmp_path}/w.txt").collect()) == ["bad", "good"]
    (tmp_path / "e.txt").write_text("2 2\na 1 2\nb 3 4\na 5 6\n")
    vec = {r.word: r.vec for r in io.embeddings(spark, f"file://{tmp_path}/e.txt", spark.createDataFrame([("a",)], "word string")).collect()}
    assert vec == {"a": [5.0, 6.0]}
    for n in ("run_1", "run_2", "run_1_x"):
        (tmp_path / n).mkdir()
    assert io.latest_run(spark, f"file://{tmp_path}").endswith("run_2") and io.latest_run(spark, f"file://{tmp_path}", suffix="_x").endswith("run_1_x")


def test_labelling(spark):
    df = spark.createDataFrame([(1, "nice", "negative"), (2, "awful", None)], "doc_id long, text string, up string")
    out, cache = labeling.label_texts(df, None, fallback="up")
    assert {r.doc_id: r.final_label for r in out.collect()} == {1: "negative", 2: "neutral"} and cache is None
    with pytest.raises(ValueError):
        labeling.label_texts(df, None, strict=True)

    def rater(p):
        if "awful" in p:
            raise RuntimeError
        return "Positive!"

    out, cache = labeling.label_texts(df, rater, "p", "m")
    assert {r.doc_id: r.final_label for r in out.collect()} == {1: "positive", 2: "neutral"}
    assert cache.count() == 3  # failures aren't cached
    again, more = labeling.label_texts(df.where("doc_id = 1"), lambda p: 1 / 0, "p", "m", cache=cache)
    assert again.first().final_label == "positive" and more.count() == 0


def test_runs_and_columns(spark, tmp_path):
    import datetime

    from textloom.config import Config

    at = f"file://{tmp_path}/runs"
    for day in (1, 2):
        run = io.run_id(datetime.datetime(2024, 1, day))
        io.write_run({"d": spark.createDataFrame([(day,)], "id long")}, run, at)
    assert [r.id for r in io.read_latest_run(spark, at, "d").collect()] == [2]
    df = spark.createDataFrame([(1, "a", "b")], "id long, text string, v1_basic_text string")
    assert io.preferred_first(df, ["text", "none"]).columns == ["text", "id", "v1_basic_text"]
    assert io.text_column(df) == "text" and io.text_column(df, "v1") == io.text_column(df, "v1_basic") == "v1_basic_text"
    with pytest.raises(ValueError):
        io.text_column(df, "v3")
    c = Config.from_env(env={"TEXTLOOM_TOP_K": "5", "TEXTLOOM_STRICT": "true", "TEXTLOOM_SUBREDDITS": "a, b"})
    assert (c.top_k, c.strict, c.subreddits, c.seed) == (5, True, ("a", "b"), 42) and c.missing(["KEY"], {}) == ["KEY"]


def test_enrich_joins_the_terms_news(spark):
    posts = spark.createDataFrame([("t", 1, "p", " Title t ", None, "3", "x", "0")], "term string, trend_rank long, post_id string, title string, selftext string, score string, num_comments string, created_utc string")
    news = spark.createDataFrame([("t", 2, "second"), ("t", 1, "first")], "term string, article_rank long, title string")
    r = collect.enrich(posts, news).first()
    assert (r.title, r.selftext, r.engagement, r.news_count_for_term, r.related_news_titles) == ("Title t", "", 3, 2, ["first", "second"])
    assert r.term_in_title and not r.has_selftext and r.created_datetime_utc == "1970-01-01T00:00:00+00:00"


def test_medians(spark):
    import statistics

    from textloom.operators.quantiles import medians

    rng = random.Random(6)
    rows = [(k, rng.choice([None, float("nan"), rng.randrange(50), rng.random() * 100]) if k != "none" else None) for k in ["a", "b", None, "none", "one"] for _ in range(1 if k == "one" else 997)]
    rows = [(k, None if v is None else float(v)) for k, v in rows] + [("one", 4.5)]
    got = {r.k: r.median for r in medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    known = {}
    for k, v in rows:
        if v is not None and v == v:
            known.setdefault(k, []).append(v)
    assert got == {k: statistics.median(v) for k, v in known.items()}


def test_polarity_rules(spark):
    rows = ["a good film", "a very good film", "not a good film", "a GOOD film", "good!!!", "good but bad", "kiss of death", "good?? really", "", None, "GOOD", "extremely really good"]
    v = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "word string, valence double")
    got = {r.doc_id: r for r in lexicon.polarity_scores(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), v, idioms=[("kiss of death", -1.5)]).collect()}
    s = lambda x: x / math.sqrt(x * x + 15)
    want = [1.9, 1.9 + 0.293, 1.9 * -0.74, 1.9 + 0.733, 1.9 + 3 * 0.292, 1.9 * 0.5 - 2.5 * 1.5, -1.5, 1.9 + 0.36, 0, 0, 1.9, 1.9 + 0.293 + 0.293 * 0.95]
    assert all(got[i].compound == pytest.approx(s(x)) for i, x in enumerate(want))
    assert got[8].neu == got[9].neu == 1.0 and got[0].pos == pytest.approx(2.9 / 4.9)


def test_polarity_moves_no_text(spark, monkeypatch):
    rows = ["a good film, but NOT a very BAD one!!", "no good", "bad " * 200, "", None, "!!!", "so good so bad"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)
    v = spark.createDataFrame([("good", 1.9), ("bad", -2.5), ("so", 1.0)], "word string, valence double")
    out = lexicon.with_polarity(df, v)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan
    near = lambda rows: {r.doc_id: tuple(round(r[c], 9) for c in ("neg", "neu", "pos", "compound")) for r in rows}
    got = near(out.collect())
    monkeypatch.setattr(lexicon, "LITERAL_WORDS", 1)
    assert near(lexicon.polarity_scores(df, v).collect()) == got and len(got) == 7
    posts = df.select(F.lit("t").alias("term"), F.col("doc_id").alias("post_id"), F.col("text").alias("title"), F.lit("").alias("selftext"), F.lit(1).alias("score"), F.lit(0).alias("num_comments"), F.lit("0").alias("created_utc"))
    monkeypatch.setattr(lexicon, "LITERAL_WORDS", 100)
    rich = collect.enrich(posts, spark.createDataFrame([("t", 1, "first")], "term string, article_rank long, title string"), valence=v)
    assert "Generate" not in (plan := rich._jdf.queryExecution().optimizedPlan().toString()) and "rightHint=(strategy=broadcast)" in plan
    assert {r.post_id: round(r.compound, 9) for r in rich.collect()} == {k: x[3] for k, x in got.items()}


def test_negation_moves_no_tokens(spark):
    rows = [(1, ["not", "a", "b", "good", "good"]), (2, ["never", " ", "", "good", None, "bad"]), (3, [None, "good"]), (4, None), (5, [])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    out = lexicon.with_scope(df, "doc_id", "tokens")
    assert not any(x in out._jdf.queryExecution().optimizedPlan().toString() for x in ("Window", "Sort", "Join"))
    want = {(1, 1, "a", True), (1, 2, "b", True), (1, 3, "good", True), (1, 4, "good", False), (2, 3, "good", True), (2, 5, "bad", False), (3, 1, "good", False)}
    assert {tuple(r) for r in out.collect()} == want


def test_raters_get_few_prompts_at_once(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("cache_key"), F.concat(F.lit("p"), "id").alias("prompt")).coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def rater(p):
        import pyarrow

        assert labeling.SLICE < 1000 and len(p) > 1 and pyarrow
        seen.add(1)
        if p == "p7":
            raise RuntimeError
        return "Positive"

    out = labeling.rate(df, rater, attempts=2)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.cache_key: (r.label, r.failed) for r in out.collect()}
    assert got["7"] == ("neutral", True) and len(got) == 1000 and sum(x == ("positive", False) for x in got.values()) == 999
    assert seen.value == 1001


def test_csv_keeps_null_and_empty_apart(spark, tmp_path):
    rows = [(1, "", "x"), (2, None, ""), (3, "a\r\nb\r", None), (4, '"",\n"', "\\"), (None, " ", "\0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    io.write_csv(df, f"file://{tmp_path}/csv")
    assert sorted(map(tuple, io.read_csv(spark, f"file://{tmp_path}/csv", df.schema).collect()), key=repr) == sorted(rows, key=repr)
