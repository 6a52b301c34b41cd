"""Corpus statistics: n-grams, term and document frequencies, TF-IDF, vocabularies, BoW."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.sources.shared import written


def each(df: DataFrame, items, name: str, *more) -> DataFrame:
    """One row an item of an array.  explode() makes Spark test the array's size in a filter that
    repeats the whole expression where the table is read, inside its lambdas too; the outer form doesn't."""
    return df.select(*more, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def unigram_freq(df: DataFrame, tokens: str = "tokens", k: int | None = 200) -> DataFrame:
    """(token, frequency), most frequent first, ties by token; k None keeps all, k <= 0 none."""
    out = each(df, tokens, "token").groupBy("token").agg(F.count("*").alias("frequency"))
    return out if k is None else out.orderBy(F.desc("frequency"), "token").limit(max(0, k))


def bigrams(tokens: str):
    """Adjacent pairs within a document, joined by a space."""
    n = F.size(tokens)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1)))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def bigram_freq(df: DataFrame, tokens: str = "tokens", k: int | None = 200) -> DataFrame:
    out = each(df, bigrams(tokens), "bigram").groupBy("bigram").agg(F.count("*").alias("frequency"))
    return out if k is None else out.orderBy(F.desc("frequency"), "bigram").limit(max(0, k))


#: Rows of a table of terms up to which it is broadcast; larger ones are joined by a shuffle.
BROADCAST_TERMS = 500_000
BROADCAST_VECTORS = 20_000


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def term_freq(df: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(key, token, tf).  Whole documents are dealt by key, in as many parts as Spark shuffles to,
    so neither the counts nor what groups them by key moves single tokens."""
    dealt = df.select(key, F.col(tokens).alias("tokens")).repartition(_parts(df), key)
    return each(dealt, "tokens", "token", key).groupBy(key, "token").agg(F.count("*").alias("tf"))


def _terms(df: DataFrame, rows: int = BROADCAST_TERMS) -> DataFrame:
    """A written table of terms, broadcast where its counted size allows, else hashed in parts."""
    return F.broadcast(df) if df.count() <= rows else df.hint("shuffle_hash")


def _idf(tf: DataFrame, n: DataFrame) -> DataFrame:
    per = tf.groupBy("token").agg(F.count("*").alias("doc_freq"))
    return per.join(F.broadcast(n)).select("token", "doc_freq", (F.log((1 + F.col("n")) / (1 + F.col("doc_freq"))) + 1).alias("idf"))  # n is one row


def inverse_df(df: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(token, doc_freq, idf); idf = ln((1 + N) / (1 + df)) + 1 with N all documents, also empty ones."""
    pairs = each(df, F.array_distinct(tokens), "token")
    return _idf(pairs, df.agg(F.count("*").alias("n")))


def tfidf(df: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(key, token, tf, tfidf): tf over the document's tokens times idf.  Term frequencies are
    written once, in buckets of the key; document frequencies are counts of their rows, so texts
    are tokenised once and terms meet their idf without a shuffle."""
    n = _parts(df)
    rows = each(df.select(key, F.col(tokens).alias("tokens")).repartition(n, key), "tokens", "token", key, F.size("tokens").alias("total"))
    tf = written(rows.groupBy(key, "total", "token").agg(F.count("*").alias("tf")), key, n)
    idf = _terms(written(_idf(tf, df.agg(F.count("*").alias("n")))))
    return tf.join(idf, "token").select(key, "token", "tf", "doc_freq", "idf", (F.col("tf") / F.col("total") * F.col("idf")).alias("tfidf"))


def tfidf_weights(df: DataFrame, key: str = "doc_id", tokens: str = "tokens", min_df: int = 1) -> DataFrame:
    """(key, token, weight): counts times idf, of all tokens in min_df documents or more, scaled to
    length 1 by document."""
    tf = written(term_freq(df, key, tokens), key, _parts(df))
    idf = _terms(written(_idf(tf, df.agg(F.count("*").alias("n"))).where(F.col("doc_freq") >= min_df)))
    rows = tf.join(idf, "token").select(key, "token", (F.col("tf") * F.col("idf")).alias("w"))
    return rows.select(key, "token", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))).alias("weight"))


def tfidf_features(df: DataFrame, key: str = "doc_id", tokens: str = "tokens", k: int = 200) -> DataFrame:
    """Means and maxima over the documents that contain a token; k <= 0 keeps all."""
    out = tfidf(df, key, tokens).groupBy("token").agg(F.max("doc_freq").alias("doc_freq"), F.max("idf").alias("idf"), F.avg("tfidf").alias("mean_tfidf"), F.max("tfidf").alias("max_tfidf"))
    ranked = out.orderBy(F.desc(F.round("mean_tfidf", 12)), F.desc("doc_freq"), "token")
    return ranked.limit(k) if k > 0 else ranked


def top_terms(df: DataFrame, key: str = "doc_id", tokens: str = "tokens", k: int = 10) -> DataFrame:
    """(key, rank, token, tfidf): each document's k best terms, ties by token."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.round("tfidf", 12)), "token"))
    return tfidf(df, key, tokens).withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "token", "tfidf")


def rendered_top_terms(df: DataFrame, key: str = "doc_id", tokens: str = "tokens", k: int = 10) -> DataFrame:
    """(key, top_terms) as "term:0.1234 | ..."; empty text for documents without terms."""
    best = top_terms(df, key, tokens, k).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "token", "tfidf"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["token"], F.lit(":"), F.format_string("%.4f", x["tfidf"]))), " | ")
    return df.select(key).join(best, key, "left").select(key, F.coalesce(text, F.lit("")).alias("top_terms"))


def vocabulary(df: DataFrame, tokens: str = "tokens", max_features: int = 1200) -> DataFrame:
    """(token, idx): the most frequent tokens; ties by token.  At most max_features rows."""
    top = unigram_freq(df, tokens, max_features)
    return top.withColumn("idx", F.row_number().over(W.orderBy(F.desc("frequency"), "token")) - 1).select("token", "idx")


def bow(df: DataFrame, key: str = "doc_id", tokens: str = "tokens", max_features: int = 1200) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, bow_counts) of the same documents from one pass over their tokens."""
    tf = written(term_freq(df, key, tokens))
    top = tf.groupBy("token").agg(F.sum("tf").alias("frequency")).orderBy(F.desc("frequency"), "token").limit(max(0, max_features))
    vocab = written(top.withColumn("idx", F.row_number().over(W.orderBy(F.desc("frequency"), "token")) - 1).select("token", "idx"))
    return vocab, tf.join(F.broadcast(vocab), "token").select(key, "idx", F.col("tf").alias("cnt"))  # max_features rows


def bow_counts(df: DataFrame, vocab: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(key, idx, cnt); tokens outside the vocabulary drop out.  vocab is bounded by max_features."""
    return term_freq(df, key, tokens).join(F.broadcast(vocab), "token").select(key, "idx", F.col("tf").alias("cnt"))


def corpus_summary(df: DataFrame, k: int = 200, tokens: str = "tokens", kept: str = "tokens_no_stop", stemmed: str = "stemmed_tokens") -> DataFrame:
    """One row: documents, empty ones, mean token counts, exported and true distinct unigrams and bigrams."""
    size = lambda c: F.size(c).cast("long")
    # Grams are counted by 16-byte hashes of theirs, never as strings, and distinct ones first
    # within a document: 128 bits tell all grams of any corpus apart.
    digest = lambda x: F.transform(x, lambda g: F.struct(F.xxhash64(g).alias("a"), F.xxhash64(g, F.lit(1)).alias("b")))
    rows = written(df.select(size(tokens).alias("a"), size(kept).alias("b"), size(stemmed).alias("c"), stemmed))  # cleaned once
    sums = rows.agg(F.count("*").alias("n_docs"), F.count_if(F.col("c") == 0).alias("n_empty"), F.avg("a").alias("avg_tokens"), F.avg("b").alias("avg_tokens_no_stop"), F.avg("c").alias("avg_stemmed"))
    count = lambda x, name: each(rows, digest(x), "g").distinct().agg(F.count("*").alias(name))
    out = sums.join(F.broadcast(count(F.col(stemmed), "unique_unigrams"))).join(F.broadcast(count(bigrams(stemmed), "unique_bigrams")))  # one row each
    return out.withColumns({"exported_unigrams": F.least(F.lit(k).cast("long"), "unique_unigrams"), "exported_bigrams": F.least(F.lit(k).cast("long"), "unique_bigrams")})


def embedding_average(df: DataFrame, vectors: DataFrame, dim: int, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(key, vec): mean vector of a document's tokens with multiplicity; zeros where none is known."""
    known = _terms(written(vectors.select(F.col("word").alias("token"), "vec")), BROADCAST_VECTORS)
    hits = term_freq(df, key, tokens).join(known, "token")
    mean = Summarizer.mean(F.col("v"), F.col("tf").cast("double"))  # whole vectors are summed, no row a dimension
    vec = hits.withColumn("v", array_to_vector("vec")).groupBy(key).agg(mean.alias("m")).select(key, vector_to_array("m").alias("vec"))
    return df.select(key).join(vec, key, "left").select(key, F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("vec"))
