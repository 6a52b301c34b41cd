"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and URL path and dealt by ranges of that order, so a host with a
third of all pages spreads over many tasks.  Each page is compared with up to NEAR pages of
its host on both sides: its text lines are aligned with each neighbour's by longest common
subsequence.  A line that most of the compared neighbours share is template text and goes.
The pages beside a range's ends are sent to both ranges, so that no page lacks a neighbour.

Lines carry what the markup says of them, and what the markup declares wins:
lines in menus, headers, footers, sidebars, notices, adverts, forms and comments go in any
case, as a menu of other words on each page is shared by nobody; lines inside a declared
article stay in any case, as neighbours that are near copies or quote the same passage share
those.  Differencing decides all other lines.  Where a host has two pages only, and they
share COPY of their lines, they are copies and show no template.  ``decided`` says what
decided a page's text: markup, differencing, or none (no neighbour on its host).

Bounds: a task holds the lines of 2 * NEAR + 1 pages; an alignment takes memory in proportion
to the lines; the driver gets the first and last key of each range, and RANGE_SAMPLE keys a
range to cut the ranges.

Defined results: null or empty html gives an empty text; a null URL has an empty
host and path; repeated rows and ids are pages of their own; an empty table
gives an empty result; unclosed tags, comments and scripts run to the end; extra columns are
ignored; very long pages are read whole, in linear time.
"""

from __future__ import annotations

import html as H
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import shuffle_partitions, small_batches, table
from textloom.llm.url_filter import host_of, path_of

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CAMEL = re.compile(r"([a-z])([A-Z])")
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
SCOPE = {"article", "aside", "body", "div", "footer", "form", "header", "html", "main", "nav", "ol", "section", "table", "td", "th", "ul"}
LISTS = {"ul", "ol", "dl", "table", "select"}
OUT_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "object", "audio", "video", "map", "head", "option", "math"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form", "alertdialog", "toolbar"}
#: Words of class and id names that mark what is not the article.
OUT_NAMES = set("nav navbar navigation menu submenu header masthead topbar footer sidebar aside widget widgets ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus respond reply replies share sharing social follow related recommended breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login signin search form skip toolbar copyright legal disclaimer tagcloud tags hidden".split())
OUT_STARTS = ("cookie", "advert", "sponsor", "sidebar", "navbar", "newsletter", "breadcrumb")
IN_NAMES = {"article", "articlebody", "post", "entry", "story", "content", "main"}
COPY = 0.8
NEAR = 2
MOST = 0.75
RANGE_SAMPLE = 20


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): H.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(text)} if text.strip() else {}


class _Stack:
    """Open tags as (tag, out, standing), with the places of each tag, so that closing one
    doesn't search the others."""

    def __init__(self):
        self.open: list[tuple[str, bool, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def top(self) -> tuple[bool, int]:
        return self.open[-1][1:] if self.open else (False, 1)

    def push(self, tag: str, out: bool, standing: int) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((tag, out, standing))

    def last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else -1

    def cut(self, i: int) -> None:
        while len(self.open) > i:
            tag = self.open.pop()[0]
            self.places[tag].pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()


def lines(html: str | None) -> list[tuple[str, int]]:
    """(text, standing) of each block: 0 out, 1 undeclared, 2 main or named content, 3 article."""
    html = html or ""
    out: list[tuple[str, int]] = []
    stack = _Stack()
    piece: list[str] = []
    at, n = 0, len(html)

    def end() -> None:
        if piece:
            if text := " ".join(H.unescape("".join(piece)).split()):
                gone, standing = stack.top()
                out.append((text, 0 if gone else standing))
            piece.clear()

    def close(tag: str, scope: set[str] = frozenset()) -> None:
        if (i := stack.last(tag)) >= 0 and all(stack.last(t) <= i for t in scope):
            end()
            stack.cut(i)

    while at < n:
        m = TAG.search(html, at)
        if not m:
            piece.append(html[at:])
            break
        if m.start() > at:
            piece.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                end()
                close(tag)
            elif tag == "br":
                piece.append(" ")
            elif tag not in VOID:
                was = stack.last(tag)
                if was >= 0 and (not stack.blocks or stack.blocks[-1] < was):
                    if stack.open[was][1]:
                        end()
                    stack.cut(was)
            continue
        if tag in BLOCK:
            end()
            close("p", SCOPE)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                close(tag, LISTS)
        elif tag == "br":
            piece.append(" ")
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else n
            continue
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        a = _attributes(m[3])
        gone, standing = stack.top()
        marks = a.get("class", "") + " " + a.get("id", "")
        names = set(re.split(r"[^a-z0-9]+", f"{marks} {CAMEL.sub(r'\1 \2', marks)}".lower()))
        mine = tag in OUT_TAGS or (tag == "header" and standing < 3) or a.get("role", "").lower() in OUT_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        if tag not in ("html", "body", "main"):
            mine = mine or bool(names & OUT_NAMES) or any(x.startswith(OUT_STARTS) for x in names)
        if tag == "article" or a.get("itemprop") == "articleBody":
            standing = 3
        elif tag == "main" or a.get("role") == "main" or tag in ("div", "section", "td") and names & IN_NAMES:
            standing = max(standing, 2)
        if mine and not gone and tag not in BLOCK:
            end()
        stack.push(tag, gone or mine, standing)
    end()
    return out


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of a longest common subsequence of a and each prefix of b, bit-parallel."""
    at: dict = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        if u := v & at.get(x, 0):
            v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(bits == 0)])


def shared(a: list[str], b: list[str]) -> set[int]:
    """Indices of the lines of a in a longest common subsequence of a and b; halves of a are
    solved one by one (Hirschberg 1975), so memory grows with the lines, not with their square."""
    out: set[int] = set()
    known = set(b)
    kept = [i for i, x in enumerate(a) if x in known]
    both = {a[i] for i in kept}
    a_, b_ = [a[i] for i in kept], [x for x in b if x in both]
    todo = [(0, len(a_), 0, len(b_))]
    while todo:
        i, j, p, q = todo.pop()
        while i < j and p < q and a_[i] == b_[p]:
            out.add(kept[i])
            i, p = i + 1, p + 1
        while i < j and p < q and a_[j - 1] == b_[q - 1]:
            out.add(kept[j - 1])
            j, q = j - 1, q - 1
        if i >= j or p >= q:
            continue
        if j - i == 1:
            if a_[i] in b_[p:q]:
                out.add(kept[i])
            continue
        mid = (i + j) // 2
        ahead, back = _lengths(a_[i:mid], b_[p:q]), _lengths(a_[mid:j][::-1], b_[p:q][::-1])
        cut = p + int(np.argmax(ahead + back[::-1]))
        todo += [(i, mid, p, cut), (mid, j, cut, q)]
    return out


def main_text(page: list[tuple[str, int]], near: list[list[tuple[str, int]]]) -> tuple[str, int, str]:
    """The main text of a page, how many of its lines most of its neighbours share, and what decided."""
    own = [t for t, _ in page]
    counts = np.zeros(len(page), np.int64)
    for other in near:
        counts[list(shared(own, [t for t, _ in other]))] += 1
    common = counts >= max(1, min(2, len(near)), MOST * len(near))
    top = max((s for _, s in page), default=0)
    if top >= 2:
        return "\n".join(t for t, s in page if s == top), int(common.sum()), "markup"
    free = [i for i, (_, s) in enumerate(page) if s == 1]
    if not near or len(near) == 1 and common[free].sum() >= COPY * len(free):
        return "\n".join(own[i] for i in free), int(common.sum()), "none"
    return "\n".join(own[i] for i in free if not common[i]), int(common.sum()), "differencing"


def _difference(batches):
    """Rows come sorted by range, host and path; a host's run is read with NEAR pages ahead."""

    def rows(run, done):
        """Pages of the run whose neighbours ahead are there, or all of an ended run."""
        out = []
        for i in range(run["at"], len(run["pages"]) if done else len(run["pages"]) - NEAR):
            page_id, url, own, page = run["pages"][i]
            if own:
                near = [run["pages"][k][3] for k in range(max(0, i - NEAR), min(len(run["pages"]), i + NEAR + 1)) if k != i]
                text, common, decided = main_text(page, near)
                out.append((page_id, url, text, len(text), len(page), common, decided))
            run["at"] = i + 1
        drop = max(0, run["at"] - NEAR)
        run["pages"] = run["pages"][drop:]
        run["at"] -= drop
        return out

    run, now = {"pages": [], "at": 0}, None
    for b in batches:
        out = []
        for page_id, url, key, own, page in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "run", "own", "html"))):
            if key != now:
                out += rows(run, True)
                run, now = {"pages": [], "at": 0}, key
            run["pages"].append((page_id, url, own, lines(page)))
            out += rows(run, False)
        if out:
            yield _batch(out)
    if out := rows(run, True):
        yield _batch(out)


def _batch(rows):
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "decided"])


KEY = ["host", "path", "page_id"]


def _range_of(key, cuts):
    """The number of cuts at or below key, by bisection over a sorted array."""

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.coalesce(F.get(cuts, mid) <= key, F.lit(False))
        return F.struct(F.when(up & (s["lo"] < s["hi"]), mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), step)["lo"]


def _ranges(keyed: DataFrame) -> DataFrame:
    """keyed with its range, dealt and sorted; pages beside a range's ends also in the next one
    of their host, where own is false."""
    spark = keyed.sparkSession
    tasks, n = shuffle_partitions(spark), keyed.count()
    parts = 8 * tasks  # ranges, so that hashing them deals tasks even shares
    every = max(1, n // (parts * RANGE_SAMPLE))
    keys = keyed.select(F.struct(*KEY).alias("key"))
    sample = sorted((tuple(r.key) for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).limit(4 * parts * RANGE_SAMPLE).collect()), key=lambda k: (k[0], k[1], k[2] is not None, k[2] or 0))
    cuts = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}, key=lambda k: (k[0], k[1], k[2] is not None, k[2] or 0)) if sample else []
    cuts = F.from_json(F.lit(json.dumps([dict(zip(KEY, c)) for c in cuts])), "array<struct<host:string,path:string,page_id:long>>")
    placed = lambda d: d.withColumn("range", _range_of(F.struct(*KEY), cuts))
    ends = placed(keyed.select(*KEY)).groupBy("range").agg(F.min(F.struct(*KEY)).alias("first"), F.max(F.struct(*KEY)).alias("last")).orderBy("range").collect()  # a row a range
    guests = []
    for a, b in zip(ends, ends[1:]):
        if a.last.host == b.first.host:
            guests += [(*a.last, b.range), (*b.first, a.range)]
    guests = spark.createDataFrame(guests, "g_host string, g_path string, g_id long, g_range int").groupBy("g_host", "g_path", "g_id").agg(F.collect_list("g_range").alias("guests"))
    same = (F.col("host") == F.col("g_host")) & (F.col("path") == F.col("g_path")) & F.col("page_id").eqNullSafe(F.col("g_id"))
    sent = placed(keyed).join(F.broadcast(guests), same, "left")  # two rows a range
    home = F.struct(F.col("range").alias("to"), F.lit(True).alias("own"))
    away = F.transform(F.coalesce("guests", F.array().cast("array<int>")), lambda g: F.struct(g.alias("to"), F.lit(False).alias("own")))
    rows = sent.select("page_id", "url", "html", "host", "path", F.explode(F.concat(F.array(home), away)).alias("s")).select("*", "s.*").withColumn("run", F.concat_ws(" ", "to", "host")).drop("s")
    return rows.repartition(tasks, "to").sortWithinPartitions("to", *KEY)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared, decided of pages(page_id, url, html)."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return _ranges(keyed).mapInArrow(_difference, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, decided string")


def op3_page_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
