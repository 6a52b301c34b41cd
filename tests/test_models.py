"""Learned models, serving and streaming on a small separable corpus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import models, serve, tree
from textloom.streaming import stream


@pytest.fixture(scope="module")
def corpus_df(spark):
    words = {"positive": "good fine nice", "negative": "bad awful poor", "neutral": "plain table stone"}
    rows = [(i, f"{w} word{chr(97 + i % 5)} item", label) for i, (label, w) in enumerate(list(words.items()) * 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string")


@pytest.fixture(scope="module")
def model(corpus_df):
    return models.fit_logistic(models.labelled(corpus_df))


def test_logistic_learns_and_serves(spark, corpus_df, model, tmp_path):
    every, wrong = serve.export(corpus_df, model)
    assert every.count() == 24 and wrong.count() == 0
    got = serve.predict_one(spark, model, "a good nice thing")
    assert got["sentiment"] == "positive" and 0 < got["confidence"] <= 1
    with pytest.raises(serve.BadRequest):
        serve.predict_one(spark, model, "!!!")
    with pytest.raises(serve.NoModel):
        serve.predict_one(spark, None, "x")
    at = f"file://{tmp_path}/model"
    serve.save_model(model, at)
    assert serve.predict_one(spark, serve.load_model(at), "awful bad")["sentiment"] == "negative"


def test_forest_svm_and_search(corpus_df):
    d = models.labelled(corpus_df)
    for m in (models.fit_forest(d, k=5, trees=10), models.fit_svm(d, k=5), models.fit_svm(d, k=5, gamma="auto")):
        assert models.macro_f1(models.predict(d, m)) > 0.8
    found = models.optimise(d, [("logreg", "fit_logistic", {"c": [0.2, 1.0], "ngrams": [2], "min_df": [2]}), ("forest", "fit_forest", {"k": [4], "trees": [5], "depth": [None], "min_split": [5]})])
    assert found["family"] == "logreg" and found["accepted_cv"] and found["accepted_test"] and len(found["tried"]) == 3


def test_candidates_share_features(corpus_df, monkeypatch):
    d = models.labelled(corpus_df)
    made = []
    monkeypatch.setattr(models, "fit_tfidf", lambda *a, f=models.fit_tfidf: made.append(a[1:]) or f(*a))
    shared = models.Features(d, 5)
    for c in (0.2, 1.0):
        assert models.macro_f1(models.predict(d, models.fit_logistic(shared, c))) > 0.8
    assert models.macro_f1(models.predict(d, models.fit_forest(shared, k=3, trees=5))) > 0.6
    assert made == [(1, 1)]
    a, b = shared.components(1, 1, 3), models.svd_components(shared.sparse(1, 1)[1], k=3)
    assert a.shape == b.shape and np.allclose(a @ a.T, b @ b.T, atol=1e-6)


def test_grid_best_tries_every_setting(monkeypatch):
    import __spark_entry__ as entry
    from textloom.plans import model_queries

    seen = []
    monkeypatch.setattr(model_queries, "training", lambda *_: None)
    monkeypatch.setattr(models, "optimise", lambda d, grid: seen.append(len(models.settings(grid))) or (_ for _ in ()).throw(KeyError))
    with pytest.raises(KeyError):
        entry.queries()["grid_best"](None, "")
    assert seen == [156]


def test_tree_against_a_plain_one(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (200, 70))
    y = np.where(x[:, 5] & x[:, 9], 2, np.where(x[:, 20], 1, 0))
    v = np.round(rng.normal(size=(200, 4)) + y[:, None] * [1, 0, 0, 0.5], 3)

    def plain(rows, cols, node, depth):
        c = [int((y[rows] == k).sum()) for k in range(3)]
        best = (0.0,)
        if depth < tree.DEPTH and len(rows) >= tree.MIN_SPLIT and max(c) < len(rows):
            for f in sorted(tree.drawn(node, cols.shape[1])):
                col = cols[rows, f]
                cut = 0.5 if cols is x else float(np.median(col))
                up, down = rows[col > cut], rows[col <= cut]
                if len(up) and len(down):
                    g = [tree.gini([int((y[r] == k).sum()) for k in range(3)]) for r in (down, up)]
                    gain = round(tree.gini(c) - (len(down) / len(rows) * g[0] + len(up) / len(rows) * g[1]), 12)
                    best = (gain, f, cut, down, up) if gain > best[0] else best
        if best[0] == 0:
            return {node: c.index(max(c))}
        return plain(best[3], cols, 2 * node + 1, depth + 1) | plain(best[4], cols, 2 * node + 2, depth + 1)

    rows = [(i, int(y[i]), np.flatnonzero(x[i]).tolist(), v[i].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, y int, present array<int>, vec array<double>")
    for name, n, sparse, cols in (("present", 70, True, x), ("vec", 4, False, v)):
        grown = tree.fit(df, name, n, sparse)
        assert grown.leaves == plain(np.arange(200), cols, 0, 0)
        assert grown.table(spark).count() == len(grown.leaves) + len(grown.splits)
    assert tree.fit(df.limit(0), "vec", 4, False).leaves == {0: 0}


def test_stream_equals_batch(spark, corpus_df, model, tmp_path):
    src, out, ck = (f"file://{tmp_path}/{n}" for n in ("in", "out", "ck"))
    corpus_df.write.parquet(src)
    s = stream.read_files(spark, src, corpus_df.schema)
    stream.run_available(s, out, ck, lambda d: stream.score_stream(d, model))
    batch = {(r.doc_id, r.pred_label) for r in models.predict(serve.prepared(corpus_df), model).collect()}
    assert {(r.doc_id, r.pred_label) for r in spark.read.parquet(out).collect()} == batch
    more = corpus_df.limit(2).withColumn("doc_id", F.col("doc_id") + 100)
    more.write.mode("append").parquet(src)
    stream.run_available(stream.read_files(spark, src, corpus_df.schema), out, ck, lambda d: stream.score_stream(d, model))
    assert spark.read.parquet(out).count() == 26


def test_svd_keeps_its_rows_and_lets_them_go(spark, corpus_df, monkeypatch):
    from pyspark.mllib.linalg.distributed import RowMatrix

    rows = models.fit_tfidf(d := models.labelled(corpus_df)).transform(d)
    kept = []
    solve = RowMatrix.computeSVD
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    monkeypatch.setattr(RowMatrix, "computeSVD", lambda self, *a, **b: kept.append(held() - before) or solve(self, *a, **b))
    assert models.svd_components(rows, k=3).shape[1] == 3
    assert kept == [1] and held() == before


def test_short_rows_are_dealt_to_all_cores(spark, corpus_df, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "written", lambda df, *a, f=models.written: seen.append(df.rdd.getNumPartitions()) or f(df, *a))
    models.fit_forest(models.labelled(corpus_df).coalesce(1), k=3, trees=3)
    assert seen[-1] == 2 * spark.sparkContext.defaultParallelism


def test_batch_predictions_are_made_once(corpus_df, model):
    every, wrong = serve.export(corpus_df, model)
    for d in (every, wrong):
        assert "UDF" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_round_trip_and_split_move_no_text(spark, monkeypatch):
    import __spark_entry__ as entry
    from textloom.plans import model_queries

    sf = "/root/testdata/sf0.001"
    out = entry.queries()["model_round_trip"](spark, sf)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    ranked = []
    monkeypatch.setattr(model_queries.sampling, "stratified_split", lambda d, *a, f=model_queries.sampling.stratified_split: ranked.append(d.columns) or f(d, *a))
    train, test = model_queries.split(spark, sf)
    assert ranked == [["doc_id", "label", "__row"]] and "text" not in train.columns
    assert train.count() + test.count() == model_queries.labelled_docs(spark, sf).count()
