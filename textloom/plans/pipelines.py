"""The composed stages: collect, preprocess, label and model, evaluate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import tokens as T
from textloom.operators import bayes, collect, corpus, evaluate, lexicon, models, sampling, tree
from textloom.sources.shared import written


def collect_stage(terms: DataFrame, news: DataFrame, posts: DataFrame, label, limit: int = 100) -> dict[str, DataFrame]:
    """The six datasets: trends, news, raw and enriched posts, two summaries."""
    ranked = terms.withColumnRenamed("trend_term", "term").select("term", "trend_rank")
    articles = collect.news_for_terms(news).join(F.broadcast(ranked), "term")  # terms: a short ranked list
    found = collect.search_posts(posts.join(F.broadcast(ranked), "term"), limit)
    rich = collect.dedup_enriched(collect.enrich(found, articles, label))
    return {"trends": terms, "news": articles, "reddit_posts_raw": collect.dedup_raw(found), "reddit_posts_enriched": rich, "term_summary": collect.term_summary(rich), "subreddit_summary": collect.subreddit_summary(rich)}


def preprocess_stage(posts: DataFrame, k: int = 200, title: str = "title", body: str = "selftext", key: str = "post_id") -> dict[str, DataFrame]:
    """Preprocessed posts, n-gram tables, TF-IDF features, top terms and the summary."""
    raw = posts.withColumns({"original_title": F.col(title), "original_selftext": F.col(body), "__all": F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))})
    out = T.preprocess(T.preprocess(T.preprocess(raw, "__all"), title, "title_"), body, "selftext_").drop("__all")
    out = out.withColumns({title: F.col("title_final_text"), body: F.col("selftext_final_text"), "processed_text": F.col("final_text"), "is_empty_after_preprocessing": F.size("stemmed_tokens") == 0})
    s = "stemmed_tokens"
    return {"preprocessed_posts": out, "unigram_freq": corpus.unigram_freq(out, s, k), "bigram_freq": corpus.bigram_freq(out, s, k), "tfidf_features": corpus.tfidf_features(out, key, s, k), "top_terms_per_post": corpus.rendered_top_terms(out, key, s), "summary": corpus.corpus_summary(out, k)}


def _tree(rows: DataFrame, features: str, n_features: int, sparse: bool, key: str) -> DataFrame:
    model = tree.fit(rows.where("split = 'train'"), features, n_features, sparse)
    return rows.where("split = 'test'").select(key, models.decode_label(model.pred()).alias("pred"))


def benchmark(df: DataFrame, lex: DataFrame, synsets: DataFrame, vectors: DataFrame, max_features: int = 1200, key: str = "doc_id", dim: int = 64, negators: list[str] | None = None) -> DataFrame:
    """18 models: three text variants x (two lexicon models + two representations x two
    classifiers), with global metrics, best macro F1 first."""
    split = sampling.stratified_split(df, "label", key)
    named = {v: T.variant(F.col("text"), v).alias(f"t_{v}") for v in T.VARIANTS}
    split = written(split.select(key, "label", "split", models.encode_label(F.col("label")).alias("y"), *named.values()))
    results = []
    for name in T.VARIANTS:
        d = split.select(key, "label", "split", "y", F.col(f"t_{name}").alias("tokens"))
        truth = d.select(key, "label", "split")
        vocab = written(corpus.vocabulary(d, "tokens", max_features))
        counts = written(corpus.bow_counts(d, vocab, key))
        train, test = truth.where("split = 'train'"), truth.where("split = 'test'")
        preds = {("lexicon", "dictionary"): lexicon.lexicon_predict(d, lex, key, negators=negators).select(key, F.col("label").alias("pred")), ("lexicon", "synset"): lexicon.synset_predict(d, synsets, key, negators=negators).select(key, F.col("label").alias("pred"))}
        preds["bow", "multinomial_nb"] = bayes.multinomial_predict(counts, test, bayes.multinomial_fit(counts, train.select(key, "label"), vocab, key), key)
        present = counts.groupBy(key).agg(F.array_sort(F.collect_set("idx")).alias("present"))  # at most max_features a row
        bow = written(d.drop("tokens").join(present, key, "left").withColumn("present", F.coalesce("present", F.array().cast("array<int>"))))
        preds["bow", "decision_tree"] = _tree(bow, "present", vocab.count(), True, key)
        words = vocab.join(vectors, F.col("idx") == F.col("vec_id")).select(F.col("token").alias("word"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
        dense = d.drop("tokens").join(corpus.embedding_average(d, words, dim, key), key)
        dense = written(dense.withColumn("vec", F.transform("vec", lambda x: F.round(x, 9))))  # whatever the order of sums
        preds["embedding", "gaussian_nb"] = bayes.gaussian_predict(dense.where("split = 'test'"), bayes.gaussian_fit(dense.where("split = 'train'")), key)
        preds["embedding", "decision_tree"] = _tree(dense, "vec", dim, False, key)
        for (rep, model), p in preds.items():
            # Written model by model: one plan of all 18 is more than the driver's memory holds.
            results.append(written(test.join(p, key).select(F.lit(name).alias("variant"), F.lit(rep).alias("representation"), F.lit(model).alias("model"), "label", "pred")))
    every = reduce(DataFrame.unionByName, results)
    by = ["variant", "representation", "model"]
    out = evaluate.metrics(evaluate.confusion(every, "label", "pred", by), by)
    return out.orderBy(F.desc("macro_f1"), F.desc("accuracy"), *by)


def evaluate_stage(df: DataFrame, grid: str = "small", key: str = "doc_id") -> dict:
    """Search, acceptance check, misclassified rows, error patterns and a conclusion."""
    found = models.optimise(df, grid, key=key)
    wrong = evaluate.misclassified(found["test"], "label", "pred_label", {"text": 400, "title": 200})
    pairs = [r.asDict() for r in evaluate.confusion_pairs(found["test"], "label", "pred_label").collect()]
    summary = evaluate.error_patterns(wrong.withColumnRenamed("clean", "clean_text")).first().asDict()
    return found | {"misclassified": wrong, "pairs": pairs, "summary": summary, "conclusion": evaluate.conclusion(summary, pairs)}
