"""Near-duplicate detection by BagMinHash.

A document is the multiset of its five-word shingles.  Each shingle with weight
w is a Poisson process over [0, w), cut into dyadic intervals: whole intervals
are one process each, the last one is thinned by point positions, so heavy
shingles need a logarithmic number of processes.  Points come in order of time
and stop once they are later than every register, which makes signatures quick;
agreement of registers is an unbiased estimate of weighted Jaccard similarity.

1. Documents are read once, in units of a few MB that are written with their band keys,
   bucketed by unit; later steps meet a unit without a shuffle, and no text is shuffled.
   Equal texts are one node.
2. 16 bands of 4 registers: at a similarity of 0.8 a pair shares a band with
   probability 0.9998.  A counting Bloom filter in parts drops band keys that occur once.
3. In bands of at most ``SMALL`` nodes all pair up, and in larger ones each with the band's
   ``PIVOTS`` most connected nodes, which in a group of near copies are the text they were
   made from and its closest copies.  This only saves work, as no class is paired with
   itself later: all nodes of larger bands, also those that have a link, are then searched
   by prefixes.  Ordered from rare to frequent, two texts that are alike share one of their
   first elements, so that a passage of many different documents pairs nobody, and no pair
   of two classes is missed.
4. Each distinct pair is verified by the exact overlap of the multisets (of 64-bit hashes).
5. Classes are connected components, by label propagation with pointer jumping
   on tables in the shared folder.

Hot bands, nodes, pivots and hubs are split by salts.  ``n_links`` counts verified links; a
link inside a class that the pivots made is not listed.

Defined results: a text of one to four words is one shingle; a text without
words (null, empty) forms a class of its own; of rows with equal doc_id and text
one stays; null ids sort last; an empty table gives an empty result; very long texts are
read whole; extra columns are ignored by ``near_classes`` and kept by ``near_dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import bloom
from textloom.llm.common import attach, keep_rows, row_key, shuffle_partitions, small_batches, spread_join, table, written
from textloom.llm.words import U, mix, parse, trim, trimmed

SHINGLE = 5
REGISTERS, BAND = 64, 4
THRESHOLD = 0.8
SMALL = 8
PIVOTS = 3
GOLD = U(0x9E3779B97F4A7C15)
#: Text bytes and rows of a unit.
UNIT_BYTES, UNIT_ROWS = 8 << 20, 20_000


def _step(i: int) -> np.uint64:
    return U(i * int(GOLD) & 0xFFFFFFFFFFFFFFFF)


def shingles(texts: list[bytes | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, shingle hash, count) of each distinct shingle, by row; rows."""
    word, row, first = parse(texts)
    n, rows = len(word), len(texts)
    sizes = np.diff(np.append(first, n))
    f = word.copy()
    for i in range(1, k):  # the last words of a row take fewer: unused unless the row is short
        nxt = np.zeros(n, np.uint64)
        nxt[: n - i] = np.where(row[: n - i] == row[i:], word[i:], U(0)) if n > i else nxt[: n - i]
        f = f * U(0xD6E8FEB86659FD93) + nxt
    f = mix(f)
    at = np.arange(n) - first[row] if n else np.empty(0, np.int64)
    use = at <= np.maximum(sizes[row] - k, 0) if n else np.empty(0, bool)
    f, r = f[use], row[use]
    order = np.lexsort((f, r))
    f, r = f[order], r[order]
    head = np.ones(len(f), bool)
    head[1:] = (f[1:] != f[:-1]) | (r[1:] != r[:-1])
    start = np.flatnonzero(head)
    return r[start], f[start], np.diff(np.append(start, len(f))), rows


def signatures(row: np.ndarray, sh: np.ndarray, count: np.ndarray, rows: int, m: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers, rows x m: the earliest point's time (float32 bits) and
    identity.  A row without shingles keeps the largest value."""
    top = np.iinfo(np.uint64).max
    sig = np.full(rows * m, top, np.uint64)
    levels = int(np.ceil(np.log2(count.max()))) + 1 if len(count) else 0
    parts = []
    for lv in range(levels):  # interval [0, 1), then [2 ** (lv - 1), 2 ** lv)
        low = 0 if lv == 0 else 1 << (lv - 1)
        i = np.flatnonzero(count > low)
        span = max(1, low)
        parts.append((row[i], mix(sh[i] + _step(lv)), np.full(len(i), span, np.uint64), np.full(len(i), low, np.int64), count[i]))
    if not parts:
        return sig.reshape(rows, m)
    r, seed, span, low, c = (np.concatenate(x) for x in zip(*parts))
    x, t = np.zeros(len(r)), 0
    while len(r):
        t += 1
        u = mix(seed + _step(t))
        v = mix(u ^ U(0x5851F42D4C957F2D))
        x = x - np.log(((u >> U(11)).astype(np.float64) + 1) * 2.0**-53) / span
        key = (x.astype(np.float32).view(np.uint32).astype(np.uint64) << U(32)) | (v >> U(32))
        inside = low + ((v >> U(8)) % span).astype(np.int64) < c
        np.minimum.at(sig, r[inside] * np.int64(m) + (v[inside] & U(m - 1)).astype(np.int64), key[inside])
        late = sig.reshape(rows, m).max(axis=1)
        go = key <= late[r]
        if not go.all():
            r, seed, span, low, c, x = r[go], seed[go], span[go], low[go], c[go], x[go]
    return sig.reshape(rows, m)


def band_keys(sig: np.ndarray, r: int = BAND) -> np.ndarray:
    ident = (sig & U(0xFFFFFFFF)).reshape(len(sig), -1, r)
    out = np.broadcast_to(np.arange(ident.shape[1], dtype=np.uint64) * GOLD, ident.shape[:2]).copy()
    for i in range(r):
        out = mix(out * U(3) + ident[:, :, i])
    return out


def elements(row: np.ndarray, sh: np.ndarray, count: np.ndarray, rows: int) -> list[np.ndarray]:
    """Each row's multiset as sorted distinct numbers: a shingle's i-th occurrence is an element."""
    r = np.repeat(row, count)
    nth = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
    e = mix(np.repeat(sh, count) + nth.astype(np.uint64) * GOLD)
    order = np.lexsort((e, r))
    ends = np.searchsorted(r[order], np.arange(rows + 1))
    e = e[order]
    return [e[ends[i] : ends[i + 1]] for i in range(rows)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted element arrays."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _content(texts: list[bytes | None]) -> list[bytes | None]:
    return [xxhash.xxh3_128_digest(b" ".join(w)) if (w := (t or b"").split()) else None for t in texts]


ROW = pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("__k1", pa.int64()), ("__k2", pa.int64()), ("node", pa.binary())])
ROW_DDL = "doc_id long, row_id long, __k1 long, __k2 long, node binary"


def _ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _read(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


@trimmed
def _units(batches):
    """Units: rows (ids and nodes), and for the unit's distinct texts nodes, texts and band keys."""
    task, count = TaskContext.get().partitionId(), 0
    rows, nodes, texts, keys, size = [], {}, [], [], 0

    def unit():
        out = [(task << 32) + count, len(nodes), bloom.pack(np.concatenate(keys) if keys else np.empty(0, np.uint64)), b"".join(nodes), _ipc(pa.Table.from_batches(rows, ROW)), _ipc(pa.table({"text": pa.array(texts, pa.large_binary())}))]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], ["unit", "n", "keys", "nodes", "rows", "texts"])

    for b in batches:
        body = b.column("text").cast(pa.binary()).to_pylist()
        node = _content(body)
        rows.append(pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_id"), b.column("__k1"), b.column("__k2"), pa.array(node, pa.binary())], schema=ROW))
        new = []
        for t, c in zip(body, node):
            if c is not None and c not in nodes:
                nodes[c] = len(nodes)
                new.append(t)
        if new:
            keys.append(band_keys(signatures(*shingles(new))).ravel())
        texts += new
        size += sum(map(len, new))
        if size >= UNIT_BYTES or sum(r.num_rows for r in rows) >= UNIT_ROWS:
            yield unit()
            count += 1
            rows, nodes, texts, keys, size = [], {}, [], [], 0
            trim()
    if any(r.num_rows for r in rows):
        yield unit()


@trimmed
def _explode_rows(batches):
    for b in batches:
        for unit, body in zip(b.column("unit").to_pylist(), b.column("rows").to_pylist()):
            t = _read(body)
            yield from t.append_column("unit", pa.array([unit] * t.num_rows, pa.int64())).to_batches()


def _split(nodes: bytes) -> list[bytes]:
    return [nodes[i : i + 16] for i in range(0, len(nodes), 16)]


def _bands(bits: int):
    """(band, node, weight) of the band keys that may be repeated; weight counts the node's."""

    @trimmed
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts, maps = right.column("part").to_pylist(), right.column("maybe").to_pylist()
        out = [pa.table({"band": pa.array([], pa.int64()), "node": pa.array([], pa.binary()), "weight": pa.array([], pa.int64())})]
        for keys, nodes in zip(left.column("keys").to_pylist(), left.column("nodes").to_pylist()):
            u = bloom.unpack(keys, np.uint64)
            m = bloom.marked(u, bits, parts, maps)
            parent = np.repeat(np.arange(len(nodes) // 16), REGISTERS // BAND)[m]
            weight = np.bincount(parent, minlength=1)[parent]
            out.append(pa.table({"band": pa.array(u[m].view(np.int64)), "node": pa.array(_split(nodes), pa.binary()).take(pa.array(parent)), "weight": pa.array(weight, pa.int64())}))
        return pa.concat_tables(out)

    return run


BODIES = pa.schema([("unit", pa.int64()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary())])
BODIES_DDL = "unit long, nodes binary, sizes binary, keys binary"


@trimmed
def _bodies(left: pa.Table, right: pa.Table) -> pa.Table:
    """The multisets of a unit's wanted nodes."""
    wanted, out = set(right.column("node").to_pylist()), []
    for unit, nodes, texts in zip(*(left.column(c).to_pylist() for c in ("unit", "nodes", "texts"))):
        own = [(i, x) for i, x in enumerate(_split(nodes)) if x in wanted]
        if own:
            body = elements(*shingles(_read(texts).column("text").take([i for i, _ in own]).to_pylist()))
            out.append((unit, b"".join(x for _, x in own), bloom.pack(np.array([len(e) for e in body], np.uint32)), bloom.pack(np.concatenate(body))))
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(BODIES)], schema=BODIES)])


def _cut(b, i):
    """Nodes of row i of a bodies batch with their element arrays."""
    ends = np.cumsum(bloom.unpack(b.column("sizes")[i].as_py(), np.uint32))
    return _split(b.column("nodes")[i].as_py()), np.split(bloom.unpack(b.column("keys")[i].as_py(), np.uint64), ends[:-1])


@trimmed
def _explode_bodies(batches):
    for b in batches:
        for i in range(b.num_rows):
            nodes, body = _cut(b, i)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([e.tobytes() for e in body], pa.binary())], ["node", "body"])


def _prefixes(least: float, bits: int):
    """Each crowded text's elements that may be the first common one of a pair, with the elements
    left from there on; short ones may be it in a pair with a text of the same size or a larger
    one.  Elements that occur once are left out."""

    @trimmed
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts, maps = right.column("part").to_pylist(), right.column("maybe").to_pylist()
        out = [[], [], [], []]
        names: list[bytes] = []
        for i in range(left.num_rows):
            nodes, body = _cut(left, i)
            rank = np.split(bloom.marked(np.concatenate(body), bits, parts, maps, True), np.cumsum([len(e) for e in body])[:-1])
            for node, e, r in zip(nodes, body, rank):
                order = np.lexsort((e, r))[: int((1 - least) * len(e) + 1e-6) + 1]
                at = np.flatnonzero(r[order] > 1)
                for o, v in zip(out, (e[order[at]].view(np.int64), np.full(len(at), len(names)), np.full(len(at), len(e)), len(e) - at)):
                    o.append(v)
                names.append(node)
        token, i, size, rest = (np.concatenate(o) if o else np.empty(0, np.int64) for o in out)
        short = rest >= size * (2 * least / (1 + least)) - 1e-6
        return pa.table({"token": pa.array(token), "node": pa.array(names, pa.binary()).take(pa.array(i)), "size": pa.array(size), "left": pa.array(rest), "short": pa.array(short)})

    return run


def _verify(least: float):
    @trimmed
    def run(batches):
        for b in batches:
            ok = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, label) for links(a, b): the smallest node of each connected component.  A round
    takes each node's least label among its neighbours, then that node's own label."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).union(links.select("a", F.col("a").alias("b"))).union(links.select("b", F.col("b").alias("a"))).distinct())
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    while True:
        near = written(spread_join(edges, labels.select(F.col("node").alias("b"), "label"), "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("mid"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old")))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = written(spread_join(near, jump, "mid", "node", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def crowded(rows: DataFrame) -> DataFrame:
    """rows(band, node, weight) of bands with two nodes or more, with the band's size n and its
    pivots: of the nodes in each of PIVOTS hash classes the one with most shared bands."""
    kind = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
    tops = {f"p{i}": F.max(F.when(kind == i, F.struct("weight", "node"))) for i in range(PIVOTS)}
    once = rows.groupBy("band", "node").agg(F.max("weight").alias("weight"))
    out = attach(once, ["band"], {"n": F.count("*"), **tops}, {"n": F.sum("n"), **{k: F.max(k).alias(k) for k in tops}}, "node").where("n > 1")
    return written(out.select("band", "node", "n", F.filter(F.array(*[F.col(f"{k}.node") for k in tops]), lambda p: p.isNotNull()).alias("pivots")))


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of crowded rows: all in small bands, with the pivots in larger ones."""
    small = rows.where(F.col("n") <= SMALL)
    pairs = small.select("band", F.col("node").alias("a")).join(small.select("band", F.col("node").alias("b")), "band").where("a < b").select("a", "b")
    star = rows.where(F.col("n") > SMALL).select("node", F.explode("pivots").alias("pivot")).where("node <> pivot")
    return pairs.union(star.select(F.least("node", "pivot"), F.greatest("node", "pivot"))).distinct()


def prefix_pairs(bodies: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (a, b) of bodies(unit, nodes, sizes, keys) that may be alike and are of
    different classes by labels(node, label), without a miss: with elements from rare to
    frequent, two texts of x and y elements that share least / (1 + least) * (x + y) have their
    first common element while at least as many are left in both.  A node without a label is a
    class of its own.  The order of elements comes from their counts over all bodies, taken in parts."""
    spark = bodies.sparkSession
    total = bodies.agg(F.sum(F.length("keys"))).first()[0] or 0
    bits = bloom.part_bits(total // 6, shuffle_partitions(spark))  # a packed element takes some 8 bytes
    rank = bloom.answers(bodies, bits, rank=True)
    rows = bodies.groupBy("unit").cogroup(rank.groupBy("unit")).applyInArrow(_prefixes(least, bits), "token long, node binary, size long, left long, short boolean")
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = written(attach(rows, ["token"], {"low": F.min("label"), "high": F.max("label")}, {"low": F.min("low"), "high": F.max("high")}, "node").where("low <> high").drop("low", "high"))
    # Classes meet first, so that the rows of a class are never paired with each other, and only
    # where their extremes allow a pair: what is left of a text beyond its own share of the need
    # must cover the other's share.
    c = least / (1 + least)
    rows = rows.withColumn("spare", F.col("left") - F.col("size") * c + 1e-6)
    per = rows.groupBy("token", "label").agg(F.max(F.when(F.col("short"), F.col("spare"))).alias("spare1"), F.min("size").alias("least"), F.max("size").alias("most"), F.max("spare").alias("spare2"))
    own = per.where("spare1 is not null").select("token", F.col("label").alias("label1"), "spare1", F.col("least").alias("least1"))
    other = per.select("token", F.col("label").alias("label2"), "spare2", F.col("least").alias("least2"), F.col("most").alias("most2"))
    meet = own.join(other, "token").where((F.col("label1") != F.col("label2")) & (F.col("least1") <= F.col("most2")) & (F.col("spare1") >= F.col("least2") * c) & (F.col("spare2") >= F.col("least1") * c))
    side = lambda s: rows.select("token", *[F.col(x).alias(x + s) for x in ("label", "node", "size", "spare", "short")])
    first = meet.join(side("1").withColumnRenamed("spare1", "own1").where("short1"), ["token", "label1"]).where((F.col("size1") <= F.col("most2")) & (F.col("own1") >= F.col("least2") * c) & (F.col("spare2") >= F.col("size1") * c))
    last = side("2").withColumnRenamed("spare2", "own2")
    pairs = first.join(last, ["token", "label2"]).where((F.col("size1") <= F.col("size2")) & (F.col("own1") >= F.col("size2") * c) & (F.col("own2") >= F.col("size1") * c))
    return pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def near_links(units: DataFrame, first: DataFrame, least: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links, labels): verified links (a, b) between the distinct texts of units, and (node,
    label) of the linked ones' components; first(node, unit) places the texts."""
    spark = units.sparkSession
    parts = shuffle_partitions(spark)
    n = units.agg(F.sum("n")).first()[0] or 0
    bits = bloom.part_bits(n * (REGISTERS // BAND), parts)
    keys = units.select("unit", "keys", "nodes")
    rows = crowded(keys.groupBy("unit").cogroup(bloom.answers(units, bits).groupBy("unit")).applyInArrow(_bands(bits), "band long, node binary, weight long"))

    def bodies_of(nodes: DataFrame) -> DataFrame:
        wanted = nodes.select("node").distinct().join(first.select("node", "unit"), "node")
        return written(units.select("unit", "nodes", "texts").groupBy("unit").cogroup(wanted.groupBy("unit")).applyInArrow(_bodies, BODIES_DDL), bucket_by="unit", buckets=parts)

    bodies = bodies_of(rows)
    flat = written(bodies.mapInArrow(_explode_bodies, "node binary, body binary"))
    xs, ys = flat.select(F.col("node").alias("a"), F.col("body").alias("x")), flat.select(F.col("node").alias("b"), F.col("body").alias("y"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs)
        half = spread_join(pairs, xs, "a", "b")
        return written(spread_join(half, ys, "b", "a", counted=pairs).select("a", "b", "x", "y").mapInArrow(_verify(least), "a binary, b binary, ok boolean").where("ok").select("a", "b"))

    links = verified(candidate_pairs(rows))
    labels = components(links)
    crowd = rows.where(F.col("n") > SMALL)
    if crowd.isEmpty():
        return links, labels
    more = verified(prefix_pairs(bodies_of(crowd), labels, least))
    # The new links join whole classes: components of classes, one edge for each pair of them.
    named = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(c + "_label"))
    between = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).distinct()
    joined = components(between).select(F.col("node").alias("old"), F.col("label").alias("new"))
    alone = joined.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    again = spread_join(labels, joined.withColumnRenamed("old", "label"), "label", "node", "left").select("node", F.coalesce("new", "label").alias("label"))
    return links.union(more), again.union(alone)


def near_classes(docs: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """doc_id, row_id, __k1, __k2, class_id, n_links, kept of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark, 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(k) for k, c in row_key().items()]).withColumn("row_id", F.monotonically_increasing_id())
    units = written(rows.mapInArrow(_units, "unit long, n long, keys binary, nodes binary, rows binary, texts binary"), bucket_by="unit", buckets=shuffle_partitions(spark))
    signed = written(units.select("unit", "rows").mapInArrow(_explode_rows, ROW_DDL + ", unit long"))
    some = signed.where("node is not null")
    first = written(some.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first"), F.min("unit").alias("unit")))
    links, labels = near_links(units, first, least)
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = first.select("node", "first").join(labels, "node").join(degree, "node")
    heads = attach(linked, ["label"], {"head": F.min("first")}, {"head": F.min("head")}, "node").select("node", "head", "n_links")
    classes = written(first.join(heads, "node", "left").select("node", F.coalesce("head", "first").alias("head"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    cols = ["doc_id", "row_id", "__k1", "__k2"]
    found = spread_join(some, classes, "node", "row_id").select(*cols, F.col("head.doc_id").alias("class_id"), "n_links", (F.col("row_id") == F.col("head.row_id")).alias("kept"))
    alone = signed.where("node is null").select(*cols, F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def near_dedup(docs: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """The rows of docs (all columns) that stay: one of each class; texts are never shuffled."""
    return keep_rows(docs, near_classes(docs, least).select("__k1", "__k2", "kept"))


def op5_bagminhash(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


#: All pairs that share a shingle, then the least doc_id that links reach.
SQL_OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
e AS MATERIALIZED (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id, k) AS nth FROM s),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b USING (k, nth) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c / (a.n + b.n - c) >= 0.8),
g AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, g.y FROM r JOIN g ON r.o = g.x)
SELECT doc_id, min(o) AS class_id, doc_id = min(o) AS kept FROM r GROUP BY doc_id
"""
