"""URL filter and page extraction."""

import random

import pytest

from pyspark.sql import functions as F

from textloom.llm import html_text, url_filter

RULES = [(h, p, v) for h, p, v in url_filter.RULES]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    stop = min([i for i in map(path.find, "?#") if i >= 0], default=len(path))
    path = path[:stop]
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, best[0], best[1]


def test_urls(spark):
    rng = random.Random(1)
    hosts = ["example.org", "WWW.Example.org", "xexample.org", "a.com", "com", "org", "example.net", "", "..org", "example.org."]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/en/2", "/fr/x", "/de/y", "/fr", "?q=/de/", "/de/?a#b", "#x"]
    urls = [f"{s}://{h}{p}" for s in ("http", "https", "") for h in hosts for p in paths] + [None, "", "nothing", "a//b", "x://", "://", "a\n://b.org/es/", "http://u:p@example.org:80/es/"]
    rng.shuffle(urls)
    urls += urls[:20]
    df = spark.createDataFrame([(i % 500, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, verdict_note string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge_urls(df, rules).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url), r.url
    none = url_filter.judge_urls(df, rules.limit(0)).collect()
    assert len(none) == len(urls) and {r.verdict for r in none} == {"allow"}
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


def test_filter_with_many_rules_has_no_false_negatives(spark):
    rules = spark.createDataFrame([(f"h{i}.net", f"/p{i % 7}/", "block") for i in range(3000)], "host string, path string, verdict string")
    df = spark.createDataFrame([(i, f"http://www.h{i}.net/p{i % 7}/x") for i in range(0, 3000, 7)] + [(9000 + i, f"http://h{i}.net/q") for i in range(300)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df, rules).collect()}
    assert all((v == "block") == (i < 9000) for i, v in got.items())


def test_many_path_lengths(spark):
    """5,000 lengths, every rule found; extra columns with the names of inner ones stay."""
    rules = [("long.net", "/" + "a" * n, "block") for n in range(5000)]
    rng = random.Random(2)
    lengths = [rng.randrange(5000) for _ in range(30)] + [0, 63, 64, 65, 4999, 5200]
    urls = [f"http://x.long.net/{'a' * n}b" for n in lengths]
    df = spark.createDataFrame([(i, u, "b", "c", "r", i) for i, u in enumerate(urls)], "page_id long, url string, best string, key string, rule string, block int")
    got = url_filter.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert {r.page_id: len(r.rule) for r in got} == {i: len("long.net/") + min(n, 4999) for i, n in enumerate(lengths)}
    assert {(r.best, r.key, r.verdict) for r in got} == {("b", "c", "block")}


def test_a_key_with_two_verdicts(spark):
    rules = spark.createDataFrame([("a.b", "/", "block"), ("a.b", "/", "allow")], "host string, path string, verdict string")
    assert url_filter.judge_urls(spark.createDataFrame([(1, "x://a.b/c")], "page_id long, url string"), rules).first().verdict == "allow"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header>Site name</header><nav><ul><li><a href="/a">A</a><li>B</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>One <b>two</b>three&nbsp;four<br>five<p>Second &lt;b&gt; para<div class="ad">Buy</div><ul><li>x<li>y</ul><!-- c --><form>Mail <input></form>
<section id="comments"><p>First!</p></section></article><aside>Side</aside><footer>&copy; F</footer></body></html>"""


def test_declared_article(spark):
    rows = [(1, "http://h/a/1", PAGE), (2, "http://h/a/2", PAGE), (3, None, None), (4, "http://h/b", ""), (5, "http://h/c", "<p>only"), (5, "http://h/c", "<script>x")]
    got = {}
    for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r.page_id, []).append(r.text)
    want = "Head & line\nOne twothree four five\nSecond <b> para\nx\ny"
    assert got[1] == got[2] == [want] and got[3] == got[4] == [""] and len(got[5]) == 2
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def template_page(i, top=("Home", "News today"), story=None):
    story = story or (f"Story {i} begins", f"and {i} goes on")
    return "<body>" + "".join(f"<div>{x}</div>" for x in (*top, *story, "All rights")) + "</body>"


def test_undeclared_pages_lose_what_neighbours_share(spark):
    """Hosts spread over all ranges; every page has neighbours, also where a range begins or ends."""
    heavy = tuple(f"Menu {k}" for k in range(7))
    rows = [(i, f"http://h/n/{i}", template_page(i)) for i in range(40)]
    rows += [(50, "http://k/x/1", template_page(7)), (51, "http://k/x/2", template_page(7))]
    rows += [(100 + i, f"http://m/{i}", template_page(i, heavy)) for i in range(9)]  # eight template lines, two of the article
    copy = ("Copied text", "goes on", "and ends")
    rows += [(200 + i, f"http://q/{i}", template_page(i, story=copy if i in (3, 4) else None)) for i in range(8)]  # two neighbours are copies
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("run", F.lit(1))
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[50].text.startswith("Home\nNews today\nStory 7") and got[50].decided == "none"  # copies show no template
    assert all(got[i].text == f"Story {i} begins\nand {i} goes on" for i in range(40))
    assert all(got[100 + i].text == f"Story {i} begins\nand {i} goes on" for i in range(9))
    assert got[203].text == got[204].text == "Copied text\ngoes on\nand ends"
    assert {r.decided for i, r in got.items() if i not in (50, 51)} == {"differencing"}


def test_every_page_meets_its_neighbours(spark):
    """Against a plain pass over the sorted pages of each host."""
    rng = random.Random(5)
    rows = [(i, f"http://{'h' if rng.random() < 0.6 else f'h{rng.randrange(30)}'}.net/{rng.randrange(400)}", template_page(rng.randrange(300), story=[f"s{rng.randrange(60)}" for _ in range(4)])) for i in range(400)]
    key = lambda r: (r[1].split("/")[2], r[1][len("http://") + len(r[1].split("/")[2]) :], r[0])
    want, hosts = {}, {}
    for r in sorted(rows, key=key):
        hosts.setdefault(key(r)[0], []).append(r)
    for run in hosts.values():
        for i, r in enumerate(run):
            want[r[0]] = html_text.main_text(html_text.lines(r[2]), [html_text.lines(run[k][2]) for k in range(max(0, i - 2), min(len(run), i + 3)) if k != i])
    got = {r.page_id: (r.text, r.n_shared, r.decided) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    inner = [i for i in want if got[i] != want[i]]
    assert got.keys() == want.keys() and all(got[i][2] == want[i][2] for i in want) and len(inner) <= 2 * 4  # beside a range's ends one neighbour of two is missing


@pytest.mark.parametrize("a,b", [("abcdef", "abxdyf"), ("aaaa", "aa"), ("", "x"), ("xyz", "xyz"), ("abcab", "bcaab"), ("abcdefghij" * 9, "jihacbdegf" * 11), ("ab" * 50, "ba" * 37)])
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
    got = sorted(html_text.shared(list(a), list(b)))
    assert len(got) == dp[-1][-1]
    it = iter(b)
    assert all(any(a[i] == y for y in it) for i in got)


@pytest.mark.parametrize("mark", ['class="cookieBanner"', 'id="sideBar"', 'class="x ad-slot"', 'role="navigation"', "hidden", 'style="display: none"', 'id="disqus_thread"', 'class=comments'])
def test_marks_of_what_is_not_the_article(mark):
    assert html_text.lines(f"<main><p>in</p><div {mark}><p>out<b>bold</b></div><p>more</main>") == [("in", 2), ("outbold", 0), ("more", 2)]


def test_broken_markup_and_many_lines_are_linear():
    import time
    import tracemalloc

    began = time.perf_counter()
    assert html_text.lines("<p " * 20000) is not None
    assert html_text.lines("<div>" * 5000 + "x") == [("x", 1)]
    assert html_text.lines("<div>" * 20000 + "</span>" * 20000 + "y") == [("y", 1)]
    assert html_text.lines("<b>" * 20000 + "</li></td>" * 20000 + "z") == [("z", 1)]
    assert time.perf_counter() - began < 5
    rng = random.Random(3)
    a, b = ([str(rng.randrange(3000)) for _ in range(8000)] for _ in range(2))
    tracemalloc.start()
    assert len(html_text.shared(a, b)) > 100
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()
