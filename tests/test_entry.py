"""The driver contract: names, oracle agreement on a sample of queries, imports."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    root = os.path.join(os.path.dirname(os.path.abspath(entry.__file__)), "textloom")
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "textloom.llm import" not in open(path, encoding="utf-8").read()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["unigram_topk", "clean_full", "lexicon_join", "metrics", "gaussian_nb_predict", "stratified_split", "tfidf_features"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "events", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(map(repr, ([x[cols.index(c)] for c in sorted(cols)] for x in rel.fetchall())))
    got = sorted(map(repr, ([r[c] for c in sorted(df.columns)] for r in df.collect())))
    assert sorted(cols) == sorted(df.columns) and got == want
