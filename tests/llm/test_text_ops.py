"""Each operator against a brute-force form on a small fixture."""

import hashlib
import os
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import bloom, bpe, exact_dedup, licenses, mixing, near_dedup, pii, quality, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
lower = lambda t: (t or "").encode().lower().decode()


def multiset(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(-1 if i is None else i)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    for t, ids in groups.items():
        own = [r for r in got if r.text_sha256 == sha(t)]
        assert len(own) == len(ids) and sum(r.kept for r in own) == 1
        assert {r.group_size for r in own} == {len(ids)} and {-1 if r.keep_id is None else r.keep_id for r in own} == {max(ids)}
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_with_many_null_ids(spark):
    """10,000 rows without an id: texts alone decide, and equal rows leave one."""
    rows = [(None, f"text {i % 4000}", i) for i in range(10_000)] + [(1, "text 1", 0), (1, "TEXT 1", 1), (2, None, 2), (None, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __k1 int").repartition(7)
    kept = exact_dedup.exact_dedup(df)
    got = kept.collect()
    assert kept.columns == df.columns and len(got) == 4001
    assert {lower(r.text) for r in got} == {lower(t) for _, t, _ in rows}
    assert {r.doc_id for r in got if lower(r.text) in ("text 1", "")} == {1, 2}


def test_keep_rows_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    from textloom.llm import common

    near = sorted(map(repr, exact_dedup.exact_dedup(docs).select("doc_id", "text").collect()))
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert sorted(map(repr, exact_dedup.exact_dedup(docs).select("doc_id", "text").collect())) == near


@pytest.mark.parametrize("keys", [500_000, 50])
def test_filter_in_parts(spark, monkeypatch, keys):
    """No repeated key is missed and the share of false positives doesn't depend on the parts."""
    monkeypatch.setattr(bloom, "KEYS", keys)
    rng = np.random.default_rng(1)
    single, double = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (6000, 500))
    every = np.concatenate([single, double, double, np.repeat(double[:1], 3000)])
    rng.shuffle(every)
    units = dict(enumerate(np.array_split(every, 7)))
    bits = bloom.part_bits(len(every), 4)
    found = bloom.answers(spark.createDataFrame([(u, bloom.pack(k)) for u, k in units.items()], "unit long, keys binary"), bits).collect()
    hit = Counter()
    for u, k in units.items():
        own = [r for r in found if r.unit == u]
        hit.update(k[bloom.marked(k, bits, [r.part for r in own], [r.maybe for r in own])].tolist())
    assert all(hit[k] >= 2 for k in double.tolist())
    assert sum(hit[k] for k in single.tolist()) < 0.03 * len(single)


def test_substring_dedup(docs, rows, empty):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - 12):
            k = tuple(w[s : s + 13])
            if i is not None:
                first[k] = min(i, first.get(k, i))
    want = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if i is not None and first[tuple(w[s : s + 13])] < i:
                gone[s : s + 13] = [True] * 13
        want[i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))] += 1
    assert multiset(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert sum(k[2] for k in want) > 500
    out = substring_dedup.substring_dedup(docs, with_text=True)
    assert all(sha(r.kept_text) == r.kept_sha256 for r in out.collect())
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_symbols_depend_on_their_context_only():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 6, 400).astype(np.uint64)
    a = np.concatenate([rng.integers(0, 6, 50).astype(np.uint64), base])
    b = np.concatenate([rng.integers(0, 6, 77).astype(np.uint64), base, rng.integers(0, 6, 9).astype(np.uint64)])

    def by_start(w):
        word, doc = substring_dedup.mix(w), np.zeros(len(w), np.int32)
        start = substring_dedup.starts_of(doc)
        return substring_dedup.anchors(word, doc, start, substring_dedup.Prints(word))

    assert (by_start(a)[50:438] == by_start(b)[77:465]).all()


def test_high_symbols_of_equal_passages_and_prints():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = (np.concatenate([rng.integers(0, 2**63, k).astype(np.uint64), base]) for k in (41, 77))
    found = [{(lo - k, hi - k) for lo, hi in zip(*(x.tolist() for x in substring_dedup.high_symbols(w, np.zeros(len(w), np.int32)))) if lo >= k + 300 and hi < k + 2700} for w, k in ((a, 41), (b, 77))]
    assert found[0] == found[1] and len(found[0]) > 60 and max(hi - lo for lo, hi in found[0]) > 80
    pa_, pb = substring_dedup.Prints(a), substring_dedup.Prints(b)
    lo = np.arange(0, 2900)
    assert all((x == y).all() for x, y in zip(pa_.of(lo + 41, lo + 60), pb.of(lo + 77, lo + 96)))
    assert len(set(zip(*(x.tolist() for x in pa_.of(lo, lo + 13))))) == len(lo)


def test_long_repeats_are_found_by_symbols(spark, monkeypatch):
    """High symbols decide most words of long repeats; without them all windows give the same result."""
    rng = np.random.default_rng(12)
    texts = [[f"w{x}" for x in rng.integers(0, 400, 900)] for _ in range(6)]
    texts += [t[:k] + ["changed"] + t[k + 1 :] for t, k in zip(texts, rng.integers(100, 800, 6).tolist())] + [texts[0][200:700]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    out = substring_dedup.substring_dedup(docs).collect()
    removed = sum(r.n_removed for r in out)
    assert removed > 5000 and sum(r.n_by_symbol for r in out) > 0.8 * removed
    monkeypatch.setattr(substring_dedup, "ITEMS", 50)
    plain = substring_dedup.substring_dedup(docs, ladder=())
    assert multiset(plain, *cols) == Counter(tuple(r[c] for c in cols) for r in out) and plain.agg(F.max("n_by_symbol")).first()[0] == 0


def five_words(t):
    """The multiset of a text's five-word shingles as (words, n-th occurrence), in plain Python."""
    w = WORD.findall(t or "")
    seen, out = Counter(), []
    for k in range(max(1, len(w) - 4) if w else 0):
        s = tuple(w[k : k + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def exact_classes(rows):
    """Classes of texts at 0.8 by comparing all pairs, without any code of the operator."""
    ids = {}
    own = [[ids.setdefault(e, len(ids)) for e in five_words(t)] for _, t in rows]
    x = np.zeros((len(rows), max(1, len(ids))), np.float32)
    for i, e in enumerate(own):
        x[i, e] = 1
    both, size = x @ x.T, x.sum(axis=1)
    alike = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-3
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(alike & (both > 0))):
        parent[find(int(i))] = find(int(j))
    out = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        out[find(i)].append(d)
    return out


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_near_dedup_recall_on_documents(spark):
    """Links of every id, among them those divisible by 20, against all rows: each partner is in the same class."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: five_words(r.text) for r in d.collect()}
    where = defaultdict(list)
    for i, e in rows.items():
        for x in e:
            where[x].append(i)
    links = []
    for q in rows:
        both = Counter(j for x in rows[q] for j in where[x])
        links += [(q, j) for j, n in both.items() if j != q and n >= 0.8 * (len(rows[q]) + len(rows[j]) - n)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(d).collect()}
    asked = [x for x in links if x[0] % 20 == 0]
    for some in (links, asked):
        assert some and sum(got[a] == got[b] for a, b in some) >= 0.9 * len(some)
    print("recall", [(sum(got[a] == got[b] for a, b in x), len(x)) for x in (links, asked)])


def test_near_dedup(docs, rows, empty):
    got = near_dedup.near_classes(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    classes = exact_classes(rows)
    for ids in classes.values():
        known = [i for i in ids if i is not None]
        if known:
            assert {by_id[i].class_id for i in known} == {min(known)}
    kept = near_dedup.near_dedup(docs.withColumn("node", F.lit(1)).withColumn("unit", F.lit(2))).drop("node", "unit")
    assert kept.columns == docs.columns and kept.count() == len(classes)
    assert near_dedup.near_classes(empty).count() == 0 and near_dedup.near_dedup(empty).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    error = []
    for _ in range(300):
        sh = rng.integers(0, 2**63, 40, dtype=np.uint64)
        ca = rng.integers(0, 9, 40)
        cb = np.where(rng.random(40) < 0.6, ca, rng.integers(0, 9, 40))
        row = np.repeat([0, 1], [(ca > 0).sum(), (cb > 0).sum()])
        sig = near_dedup.signatures(row, np.concatenate([sh[ca > 0], sh[cb > 0]]), np.concatenate([ca[ca > 0], cb[cb > 0]]), 2)
        error.append((sig[0] == sig[1]).mean() - np.minimum(ca, cb).sum() / np.maximum(ca, cb).sum())
    assert abs(np.mean(error)) < 0.012


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 80):
        w = list(base)
        for at in rng.integers(0, 300, 3):
            w[at] = f"n{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in near_dedup.near_classes(df).collect()} == {0}


def passage_docs(docs, passage, own, groups, copies):
    """Documents that share a passage, with groups of near copies among them that differ in ten words."""
    rng = np.random.default_rng(7)
    w = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    common, texts = w(passage), []
    for g in range(docs):
        mine = w(own)
        texts.append(common + mine)
        texts += [common + mine[: -10] + w(10) for _ in range(copies if g < groups else 0)]
    return [(int(i), " ".join(x)) for i, x in zip(rng.permutation(len(texts)), texts)]


def classes_of(spark, rows):
    got = defaultdict(set)
    for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.class_id].add(r.doc_id)
    return sorted(map(sorted, got.values()))


def test_near_copies_that_share_a_passage_with_many(spark):
    rows = passage_docs(1000, 160, 27, 60, 1)  # unrelated documents are 0.74 alike, planted pairs 0.9
    want = sorted(map(sorted, exact_classes(rows).values()))
    assert sum(len(c) == 2 for c in want) == 60
    assert classes_of(spark, rows) == want


def test_hot_keys_are_split(spark, monkeypatch):
    from textloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = passage_docs(60, 160, 27, 20, 3)
    assert classes_of(spark, rows) == sorted(map(sorted, exact_classes(rows).values()))


def test_groups_of_near_copies_and_links_between_groups(spark):
    rng = np.random.default_rng(8)
    w = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    rows = passage_docs(300, 160, 27, 60, 2)
    for _ in range(4):  # two hubs with near copies, 0.74 alike, and texts between the hubs that are 0.85 alike with both
        base, x, y = w(200), w(30), w(30)
        texts = [base[:-15] + base[:15] + own for own in (x, y)]
        texts += [t[:k] + ["copy"] + t[k + 1 :] for t in texts for k in range(5, 180, 9)]
        texts += [base + x[:15] + y[:15], base[:-15] + x[15:] + base[:15] + y[:15]]
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
    assert classes_of(spark, rows) == sorted(map(sorted, exact_classes(rows).values()))


def test_quality(docs, rows, empty):
    got = quality.judged(docs.select("doc_id", "text"))
    want = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        n = len(w)
        c = Counter(tuple(w[k : k + 5]) for k in range(n - 4))
        cover = {j for k in range(n - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want[i, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), n < 10 or 100 * len(cover) > 20 * n] += 1
    assert multiset(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not any(r.kept for r in got.collect() if r.base_failed)
    out = quality.quality_filter(docs)
    assert out.columns == docs.columns and 0 < out.count() < len(rows) and quality.quality_filter(empty).count() == 0


def test_quality_rejects_junk(spark):
    words = [f"{a}{b}" for a in ("stone", "river", "green", "light") for b in ("a", "e", "i", "o", "u")]
    clean = ". ".join("the " + w + " of " + v for w, v in zip(words, reversed(words)))
    rows = [(1, clean), (2, "%%% ".join(words * 1) + "%%%"), (3, " | ".join(words)), (4, "\n".join(["same line here again"] * 9 + words))]
    assert [r.doc_id for r in quality.quality_filter(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [1]


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return path, t


def test_bpe(docs, rows, empty):
    path, t = tokenizer()
    want = Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    out = bpe.encode(docs, path, with_ids=True)
    assert multiset(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert all(len(r.ids) == r.n_tokens for r in out.collect())
    assert bpe.encode(empty, path).count() == 0


def test_bpe_of_a_file_that_looks_across_white_space(docs, rows, monkeypatch):
    """Its texts are encoded whole."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    assert bpe.separable(open(P.path("word_bpe_49k.json"), encoding="utf-8").read()) and not bpe.separable(open(path, encoding="utf-8").read())
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 500)
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert multiset(bpe.encode(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_special_cases_and_decode(spark):
    path, t = tokenizer()
    texts = ["It's <|endoftext|> we'll", "İstanbul ﬁ \u00a0x \u2028y", "e\u0301 \u0301e", "a\x1fb\x85c", "数字 123 😀!!", "\u3000"]
    out = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, with_ids=True)
    for r in out.collect():
        assert r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids
    for r in bpe.decode(out, path).collect():
        assert r.text == t.decode(t.encode(texts[r.doc_id], add_special_tokens=False).ids, skip_special_tokens=False)


def base_spans(t):
    def luhn(d):
        s = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
        return sum(x - 9 if x > 9 else x for x in s) % 10 == 0

    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, a, b) for a, _, k, b in sorted(out)]


PII = [
    "a@b.c_d@e.f x@y.z@q.r .a@b-c.d.", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3", "4111 1111 1111 1111  4111-1111-1111-1111- 4", "4111 1111 1111 1112", "+1 (743) 555-3824 +49 30 123456789012345 +12 ++1234567890",
    "é😀 bob@x.org +1 743 555 3824", "call 743-555-3824 token = \"abcdef123456abcdef99\" 123-45-6789 bob [at] mail [dot] com", "1 " * 20000, "a" * 50000 + "@b" + ".c" * 20000, "9" * 40000, "+" * 20000 + "1" * 11, None, "",
]


def test_pii(spark, docs, empty):
    df = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.detect(df).collect()}
    assert len(rows) == len(PII)
    for i, t in enumerate(PII):
        assert [(x.kind, x.start, x.end) for x in rows[i].base] == base_spans(t or "")
        assert not any(a.start < b.end and b.start < a.end for a in rows[i].added for b in rows[i].base)
    assert {x.kind for x in rows[6].added} >= {"phone", "secret", "id"}  # with so few spans EM decides the rest
    assert all(not r.base and not r.added for r in pii.detect(docs).collect()) and pii.detect(empty).count() == 0


def plain_added(texts):
    """The added spans by plain Python: wide patterns, votes, EM, naive Bayes."""
    first = lambda r: [n for x in r.split() for n in range(int(x.split("-")[0]), int(x.split("-")[-1]) + 1)]
    begins = lambda d, r: any(d.startswith(str(n)) for n in first(r))
    wide = {"email": pii.SPELLED, "phone": pii.NATIONAL, "secret": pii.SECRET, "id": pii.IDENTITY}
    raw = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    found, counts = [], Counter()
    for t in texts:
        base = [(k, a, b, "b") for k, a, b in base_spans(t or "")]
        more = [(k, m.start(), m.end(), "w") for k, p in wide.items() for m in re.finditer(p, t or "")]
        more = [x for x in more if not any(y[1] < x[2] and x[1] < y[2] for y in base)]
        rows = []
        for k, a, b, w in base + more:
            s, before = t[a:b], t[max(0, a - 40) : a]
            prev = max([m.end() for m in re.finditer(raw[k] if w == "b" else wide[k], t) if m.end() <= a], default=0)  # context ends at the last match of the pattern
            before = before[-(a - prev) :] if a > prev else ""
            d = re.sub("[^0-9]", "", s)
            gaz = {
                "email": lambda: re.split(r"[.\s]+", re.sub(r"[\[(]dot[\])]", ".", s.lower()))[-1] in pii.ENDINGS,
                "phone": lambda: begins(d, pii.DIALLING) if w == "b" else bool(re.match(r"[2-9][0-8][0-9][2-9]", d)),
                "ip": lambda: not re.search(pii.RESERVED, s),
                "card": lambda: begins(d, pii.ISSUERS),
                "secret": lambda: re.match(r"[a-z_]*", s.lower())[0] in pii.KEY_NAMES,
                "id": lambda: 1_010_001 <= int(d) <= 772_999_999 and len(set(d)) > 1,
            }[k]()
            feature = {"email": len(s) < 64, "secret": '"' in s, "id": True}.get(k, bool(re.search(r"[().\x20-]", s)))
            votes = "".join(str(int(v)) for v in (bool(re.search(pii.STRICT[k], s)), gaz, bool(re.search(pii.CUES[k], before))))
            code = f"{k}|{votes}|{w}|{int(feature)}"
            counts[code] += 1
            rows.append((k, a, b, code))
        found.append(rows)
    accepted = set()
    for kind in pii.KINDS:
        own = {c: n for c, n in counts.items() if c.startswith(kind + "|")}
        prior, hit, slip = 0.5, [0.8, 0.8, 0.6], [0.2, 0.2, 0.1]

        def post(v):
            yes, no = prior, 1 - prior
            for i, x in enumerate(v):
                yes, no = yes * (hit[i] if x == "1" else 1 - hit[i]), no * (slip[i] if x == "1" else 1 - slip[i])
            return yes / (yes + no)

        n = sum(own.values())
        for _ in range(30):
            y = {c: post(c.split("|")[1]) * k for c, k in own.items()}
            total = sum(y.values())
            on = lambda c, i: c.split("|")[1][i] == "1"
            new_hit = [(sum(y[c] for c in own if on(c, i)) + 4 * [0.8, 0.8, 0.6][i]) / (total + 4) for i in range(3)]
            slip = [(sum(own[c] - y[c] for c in own if on(c, i)) + 4 * [0.2, 0.2, 0.1][i]) / (n - total + 4) for i in range(3)]
            hit, prior = new_hit, (total + 2) / (n + 4)
        p = {c: post(c.split("|")[1]) for c in own}
        py, pn = sum(own[c] * p[c] for c in own), sum(own[c] * (1 - p[c]) for c in own)
        parts = lambda c: [f"v{i}={x}" for i, x in enumerate(c.split("|")[1])] + ["f=" + c.split("|")[3]]
        for c in own:
            score = np.log((py + 1) / (pn + 1))
            for f in parts(c):
                yes, no = (sum(own[o] * q(p[o]) for o in own if f in parts(o)) for q in (lambda v: v, lambda v: 1 - v))
                score += np.log((yes + 1) / (py + 2) / ((no + 1) / (pn + 2)))
            if score > 0 and "|w|" in c:
                accepted.add(c)
    return [sorted((k, a, b) for k, a, b, c in rows if c in accepted) for rows in found]


def test_pii_added_spans(spark):
    rng = np.random.default_rng(4)
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    makers = [
        lambda: f"call {rng.integers(2, 9)}{num(2)}-555-{num(4)} now", lambda: f"part {num(3)}.{num(3)}.{num(4)} of", lambda: f'login token = "{num(9)}abcDEF{num(5)}"', lambda: f"key: {'z' * rng.integers(8, 300)} end",
        lambda: f"ssn {rng.integers(100, 700)}-{num(2)}-{num(4)}", lambda: f"id 000-{num(2)}-{num(4)}", lambda: f"mail bob{num(2)} [at] host{num(1)} [dot] com", lambda: f"x{num(2)}(at)y(dot)zz", lambda: f"call +49 30 {num(8)}", lambda: f"from 10.{num(2)}.1.{num(2)} and 8.8.{num(1)}.8",
        lambda: "4111 1111 1111 1111", lambda: f"+{num(12)}", lambda: f"write a{num(2)}@b.org or c@d.{num(2)}",
    ]
    texts = [" ".join(makers[i]() for i in rng.integers(0, len(makers), 5)) for _ in range(120)] + [None, "plain"]
    got = {r.doc_id: sorted((x.kind, x.start, x.end) for x in r.added) for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = plain_added(texts)
    assert sum(map(len, want)) > 100 and [got[i] for i in range(len(texts))] == want
    taken = {k for rows in want for k, _, _ in rows}
    assert {"secret", "phone"} <= taken


def test_em_finds_the_unreliable_labeler(spark):
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.5
    flip = lambda p: np.where(rng.random(4000) < p, ~y, y)
    votes = Counter("".join("1" if v else "0" for v in x) for x in zip(flip(0.05), flip(0.1), flip(0.45)))
    df = spark.createDataFrame([(f"phone|{k}|w|1", n) for k, n in votes.items()], "code string, n long")
    p = {r.votes: r.p for r in pii.reliabilities(df).collect()}
    assert p["110"] > 0.9 and p["001"] < 0.1 and p["111"] > p["110"] - 0.02


def scanned(texts):
    import pyarrow as pa

    return next(licenses._scan([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])])).to_pylist()


@pytest.mark.parametrize("width", [70, 75, 80])
def test_wrapped_notices(width):
    long = [(i, t) for i, t in licenses.TEMPLATES if len(t) > width]
    texts = [f"{mark}Other text here\n\n" + "\n".join(mark + x for x in textwrap.wrap(t, width)) + f"\n{mark}and more words follow.\n\nEnd" for mark in ("", " * ", "# ") for _, t in long]
    assert [r["licenses"] for r in scanned(texts)] == [i for i, _ in long] * 3


def test_licences_of_several_paragraphs():
    """Whole licence files, as they are laid out: 80 columns, blank lines, a holder's name and list items."""
    wrap = lambda *ps: "\n\n".join("\n".join(textwrap.wrap(p, 80)) for p in ps)
    L = licenses
    mit = wrap("MIT License", "Copyright (c) 2021 A. Holder", L._MIT_GRANT, L._MIT_NOTICE, L._MIT_WARRANTY)
    one, two = L._BSD_START.split(" 2. Redistributions in")
    bsd = wrap("Copyright (c) 2020, A. Holder. All rights reserved.", one, "2. Redistributions in" + two, L._BSD_NAME, L._BSD_WARRANTY)
    bsd2 = wrap("Copyright (c) 2020, A. Holder", L._BSD_START, L._BSD_WARRANTY)
    gpl, warranty = L._GNU.format(name="General Public License", v=3).split(" This program is distributed")
    rest = wrap("some code " * 400)
    texts = [mit, bsd, bsd2, wrap(gpl, "This program is distributed" + warranty), f"{rest}\n\n{mit}\n\n{rest}\n\n{bsd}\n"]
    assert [r["licenses"] for r in scanned(texts)] == ["MIT", "BSD-3-Clause", "BSD-2-Clause", "GPL-3.0", "MIT,BSD-3-Clause"]


def test_a_very_long_block_and_odd_rows(spark):
    line = "copyright and warranty words without a notice\n"
    text = line * 3000 + "Licensed under CC BY-SA 4.0.\n" + line * 3000
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, "Released under the MIT License.", "b"), (2, None, "c")], "doc_id long, text string, licenses string")
    assert sorted((r.doc_id or 0, r.licenses) for r in licenses.scan(df).collect()) == [(0, "MIT"), (1, "CC-BY-SA-4.0"), (1, "CC-BY-SA-4.0"), (2, "")]


def test_the_winner_is_the_first_confirmed_of_the_ranking():
    """All templates are ranked for all blocks by sizes computed here, and the first whose wording holds is taken."""
    import zstandard

    rng = np.random.default_rng(3)
    m = licenses.Matcher()
    for spdx, t in licenses.TEMPLATES:
        w = t.split()
        for at in rng.integers(0, len(w), len(w) // 30).tolist():
            w[at] = "other"
        block = "before it " + " ".join(w) + " and after"
        size = lambda d: len(zstandard.ZstdCompressor(level=3, **({"dict_data": zstandard.ZstdCompressionDict(d.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if d else {})).compress(block.encode()))
        saved = [size("") - size(x) for _, x in licenses.TEMPLATES]
        order = sorted(range(len(saved)), key=lambda i: (-saved[i], i))
        first = next((i for i in order if saved[i] >= licenses.LEAST_SAVED * m.size[i] and m.wording(licenses.words(block), i)), None)
        got = m.matches(block)
        assert [g[0] for g in got][:1] == ([licenses.TEMPLATES[first][0]] if first is not None else [])
        if first is not None:
            assert got[0][1] == saved[first] / size("")


def test_licenses(spark, empty):
    rows = [(1, "Text\nReleased under the MIT License.%%%\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, "This work is licensed under the GNU General Public License, version 2."), (4, "A licence to kill"), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (8, "licensed under the apache license version 3.0"), (9, "No cue here")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.licenses for i, r in got.items()} == {1: "MIT", 2: "Apache-2.0", 3: "GPL-2.0", 4: "", 5: "", 6: "", 7: "CC-BY-NC-4.0,MIT", 8: "", 9: ""}
    assert all(r.best_reduction > 0.2 for r in got.values() if r.licenses) and licenses.scan(empty).count() == 0


def test_templates_match_themselves():
    m = licenses.Matcher()
    for spdx, text in licenses.TEMPLATES:
        assert m.matches(text)[0][0] == spdx and m.ranked(text)[0][0] > 0.5 * len(m.alone.compress(text.encode()))


def test_mixing(docs, rows, empty):
    out = mixing.mixed(docs, entropy=0.97, max_epochs=3.0).collect()
    assert len(out) == len(rows)
    tokens, taken = Counter(), Counter()
    for r in out:
        tokens[r.source] += r.n_tokens
        taken[r.source] += r.n_tokens * r.copies
    total = sum(tokens.values())
    w = {r.source: r.weight for r in out if tokens[r.source]}
    share = {s: n / total for s, n in tokens.items() if n}

    def weights(a):
        z = sum(p**a for p in share.values())
        return {s: p**a / z for s, p in share.items()}

    spread = lambda x: -sum(v * np.log(v) for v in x.values())
    worst = lambda x: max(x[s] / share[s] for s in x)
    grid = [i / 2000 for i in range(2001)]
    high = max((a for a in grid if spread(weights(a)) >= 0.97 * np.log(len(share))), default=0)
    low = min(a for a in grid if worst(weights(a)) <= 3.0)
    want = weights(max(high, low))
    assert all(abs(w[s] - want[s]) < 2e-3 for s in want)
    assert all(taken[s] <= w[s] * total + 1 for s in w)  # a budget is never exceeded
    assert mixing.mixed(empty).count() == 0
    kept = mixing.realised(docs, entropy=None, max_epochs=2.0, cover=True)
    assert kept.columns == docs.columns and kept.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("how", [{"entropy": 0.97, "max_epochs": 3.0}, {"entropy": None, "max_epochs": 2.0, "cover": True}, {"entropy": 0.8, "max_epochs": None, "budget_tokens": 900.0}])
def test_mixing_of_more_sources_than_a_row_holds(docs, monkeypatch, how):
    want = sorted(map(repr, mixing.mixed(docs, **how).select("doc_id", "copies", F.round("weight", 9)).collect()))
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(repr, mixing.mixed(docs, **how).select("doc_id", "copies", F.round("weight", 9)).collect())) == want


def test_mixing_keeps_columns_of_any_name(docs):
    names = ["cut", "cut2", "whole", "exponent", "epochs", "weight", "__src", "__row", "tokens"]
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names])
    out = mixing.mixed(wide)
    assert set(out.columns) == set(wide.columns) | {"n_tokens", "copies"} and out.first().cut == "cut"
    assert mixing.realised(wide).columns == wide.columns


def test_mixing_meets_its_budget(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 9}", "w " * (1 + i % 5)) for i in range(6000)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string"), entropy=0.9)
    sums = out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("got"), (F.first("epochs") * F.sum("n_tokens")).alias("want")).collect()
    assert all(0.98 * r.want <= r.got <= r.want + 1e-6 for r in sums)
