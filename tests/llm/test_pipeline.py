"""The corpus pipeline stage by stage, against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from textloom.llm import common, quality
from tests.llm.test_text_ops import exact_classes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIXED = {"mean_word_chars": (2.0, 12.0), "symbol_ratio": (None, 0.15), "mark_ratio": (None, 0.5), "dup_line_ratio": (None, 0.45)}


def passes(t):
    """The quality verdict of a text."""
    w = WORD.findall(t or "")
    n = len(w)
    c = Counter(tuple(w[k : k + 5]) for k in range(n - 4))
    cover = {j for k in range(n - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    if n < 10 or 100 * len(cover) > 20 * n:
        return False
    lines = [x for x in t.split("\n") if WORD.search(x)]
    stops = len({x for x in w if x in {f(s) for s in quality.STOP_WORDS for f in (str, str.capitalize)}})
    got = {"mean_word_chars": sum(map(len, w)) / n, "symbol_ratio": len(re.findall(r"[#*$%&|<>]", t)) / n, "mark_ratio": len(re.findall(r"[!{}\\^~=]", t)) / n, "dup_line_ratio": (len(lines) - len(set(lines))) / max(1, len(lines))}
    return all((low is None or got[k] >= low) and (high is None or got[k] <= high) for k, (low, high) in FIXED.items()) and (n < 50 or stops >= 1) and (n < 80 or stops >= 2)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark, docs):
    """Each stage against plain Python on its own input, with columns whose names clash kept."""
    now = docs.withColumns({"epochs": F.lit(1.5), "copies": F.lit("c"), "unit": F.lit(0), "__k1": F.lit(2)})
    columns, seen = now.columns, [rows_of(now)]
    at = {c: i for i, c in enumerate(columns)}
    text, doc = at["text"], at["doc_id"]
    for name, stage in corpus_pipeline.STAGES:
        now = common.written(stage(spark, now, ""))
        if stage is not corpus_pipeline.encode:
            assert now.columns == columns, name
            seen.append(rows_of(now))
    start, first, second, third, fourth = seen
    assert Counter(first) == Counter(r for r in start if passes(r[text]))
    low = lambda t: t.encode().lower()
    groups = defaultdict(list)
    for r in first:
        groups[low(r[text])].append(-1 if r[doc] is None else r[doc])
    assert Counter((low(r[text]), -1 if r[doc] is None else r[doc]) for r in second) == Counter((t, max(ids)) for t, ids in groups.items())
    assert all(r in first for r in second)
    least = [min(ids, key=lambda i: (i is None, i or 0)) for ids in exact_classes([(r[doc], r[text]) for r in second]).values()]
    assert Counter(r[doc] for r in third) == Counter(least) and all(r in second for r in third)
    copies = Counter(fourth)
    tokens, taken = Counter(), Counter()
    for r in third:
        n = len(WORD.findall(r[text]))
        tokens[r[at["source"]]] += n
        taken[r[at["source"]]] += n * copies[r]
        assert 1 <= copies[r] <= 2
    assert set(copies) == set(third) and max(taken[s] / tokens[s] for s in tokens) <= 2
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for r in fourth:
        ids = t.encode(r[text], add_special_tokens=False).ids
        want[r[doc], tuple(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in now.collect()) == want


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() > 0
    docs.limit(0).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
