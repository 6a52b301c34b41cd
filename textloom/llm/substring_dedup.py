"""Substring deduplication by recompression.

Documents are read once.  Units of a few MB are written, bucketed by unit, as a dictionary of
distinct words and codes into it; each later step meets its units without a shuffle, and no
text is shuffled.  Rounds of recompression name maximal runs of equal symbols, then pairs (a
left-class symbol followed by a right-class one, classes drawn from the names).  Names are
content hashes, so every task names alike; equal word sequences get equal interior symbols
wherever they stand.  Three Spark rounds settle them globally:

1. Low symbols.  Each window takes as anchor the interior symbol with the longest context
   inside the window (or its own fingerprint where none does).  A counting Bloom filter in
   parts tells which anchors may occur in two places; the others' windows are unique.
2. High symbols.  The symbols of the rounds in ``LADDER``, some 20 and 90 words long, and whole
   documents are shuffled by name wherever all their windows may be repeated.  A symbol that
   a smaller doc_id has too is a verified long repeat: all its words go, and none of its
   windows is looked at again.
3. Windows.  What is left, windows across the ends of symbols and at the edges of repeats, is
   shuffled as single windows.

Equality of symbols and windows is that of 128-bit fingerprints and lengths: n of them give
some n * n / 7e38 false agreements, 3e-13 for 1.5e13 windows.  Rounds 2 and 3 reduce what they
send to the smallest doc_id within a unit first, so a passage in a third of all documents is
one entry a unit, and settle it in parts of about ``ITEMS`` entries.

``n_by_symbol`` counts the removed words that high symbols decide; without rounds it is 0, and
all windows go the last way, with the same result.

Defined results: a null or empty text has no words; a null doc_id is neither
smaller nor larger than any other, so such rows stay whole; rows that share a
doc_id don't remove each other's words; an empty table gives an empty result;
extra columns are ignored; a very long text is a unit of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import bloom
from textloom.llm.common import shuffle_partitions, small_batches, table, written
from textloom.llm.words import U, mix, trim

WINDOW = 13
ROUNDS = 3
LADDER = (10, 15)
FAR = 1 << 30
#: Text bytes and rows of a unit; entries that a part settles at a time.
UNIT_BYTES, UNIT_ROWS = 4 << 20, 20_000
ITEMS = 300_000
GOLD = U(0x9E3779B97F4A7C15)
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def symbols(word: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the last round's symbols and the word range [lo, hi) each depends on."""
    n = len(word)
    if not n:
        return word, np.empty(0, np.int64), np.empty(0, np.int64)
    # Runs of equal words; a run depends on the words beside it.
    edge = np.ones(n, bool)
    edge[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    name = np.where(end - start > 1, mix(word[start] + (end - start).astype(np.uint64) * U(0x9E3779B97F4A7C15)), word[start])
    d = doc[start]
    first, last = np.ones(len(d), bool), np.ones(len(d), bool)
    first[1:] = last[:-1] = d[1:] != d[:-1]
    lo, hi = np.where(first, -FAR, start - 1), np.where(last, FAR, end + 1)
    for r in range(rounds):
        right = (mix(name ^ U(0xA5A5 + r)) & U(1)).astype(bool)
        same = d[1:] == d[:-1]
        pair = np.zeros(len(name), bool)
        pair[:-1] = same & ~right[:-1] & right[1:]
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # What a symbol that stays single depends on: the neighbour that it might have joined.
        to_right, to_left = ~pair & ~second & ~right, ~pair & ~second & right
        next_hi, prev_lo = np.append(np.where(same, hi[1:], FAR), FAR), np.append(-FAR, np.where(same, lo[:-1], -FAR))
        next_lo, prev_hi = np.append(lo[1:], FAR), np.append(-FAR, hi[:-1])
        reach = pair | to_right
        new_hi = np.where(reach, np.maximum(hi, next_hi), np.where(to_left, np.maximum(hi, prev_hi), hi))
        new_lo = np.where(to_left, np.minimum(lo, prev_lo), np.where(reach, np.minimum(lo, next_lo), lo))
        joined = name.copy()
        at = np.flatnonzero(pair)
        joined[at] = mix(name[at] * U(0x9E3779B97F4A7C15) + mix(name[at + 1]) + U(r))
        keep = ~second
        name, lo, hi, d = joined[keep], new_lo[keep], new_hi[keep], d[keep]
    return name, lo, hi


def high_symbols(word: np.ndarray, doc: np.ndarray, ladder=LADDER, least: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges [lo, hi) of the symbols of the ladder's rounds and of whole documents, of least words or more."""
    n = len(word)
    if not n or not ladder:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.ones(n, bool)
    edge[1:] = doc[1:] != doc[:-1]
    ends = np.append(np.flatnonzero(edge), n)
    found = [(ends[:-1], ends[1:])]
    edge[1:] |= word[1:] != word[:-1]
    at = np.flatnonzero(edge)
    size = np.diff(np.append(at, n))
    name, d = np.where(size > 1, mix(word[at] + size.astype(np.uint64) * GOLD), word[at]), doc[at]
    for r in range(max(ladder) + 1):
        right = (mix(name ^ U(0x5A5A + r)) & U(1)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = (d[1:] == d[:-1]) & ~right[:-1] & right[1:]
        i = np.flatnonzero(pair)
        name[i] = mix(name[i] * GOLD + mix(name[i + 1]) + U(r))
        keep = np.ones(len(name), bool)
        keep[i + 1] = False
        name, at, d = name[keep], at[keep], d[keep]
        if r in ladder:
            found.append((at, np.append(at[1:], n)))
    lo, hi = (np.concatenate(x) for x in zip(*found))
    long = hi - lo >= least
    return lo[long], hi[long]


class Prints:
    """128-bit fingerprints of word ranges, from two prefix sums of powers."""

    def __init__(self, word: np.ndarray):
        self.sums, self.back = [], []
        for base, w in zip(BASES, (word, mix(word ^ GOLD))):
            power = np.multiply.accumulate(np.concatenate([[U(1)], np.full(max(0, len(w) - 1), U(base))])) if len(w) else w
            self.sums.append(np.concatenate([[U(0)], np.cumsum(w * power, dtype=np.uint64)]))
            self.back.append(np.multiply.accumulate(np.concatenate([[U(1)], np.full(max(0, len(w) - 1), U(pow(base, -1, 1 << 64)))])) if len(w) else w)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (hi - lo).astype(np.uint64) * GOLD
        return tuple(mix((s[hi] - s[lo]) * b[lo] + size) for s, b in zip(self.sums, self.back))


def starts_of(doc: np.ndarray, k: int = WINDOW) -> np.ndarray:
    n = len(doc) - k + 1
    return np.flatnonzero(doc[:n] == doc[k - 1 :]) if n > 0 else np.empty(0, np.int64)


def anchors(word: np.ndarray, doc: np.ndarray, start: np.ndarray, prints: Prints, k: int = WINDOW) -> np.ndarray:
    """The anchor of each window."""
    n = len(word) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    name, lo, hi = symbols(word, doc)
    ok = (hi - lo <= k) & (lo >= 0)
    name, lo, hi = mix(name[ok]), lo[ok], hi[ok]
    rank = (U(15) - (hi - lo).astype(np.uint64) << U(60)) | (name >> U(4))
    none = np.iinfo(np.uint64).max
    best = np.full(n, none, np.uint64)
    for t in range(k):
        s = hi - k + t
        m = (s <= lo) & (s >= 0) & (s < n)
        np.minimum.at(best, s[m], rank[m])
    best = best[start]
    return np.where(best == none, prints.of(start, start + k)[0], mix(best))


# ---- units ----
UNIT = "unit long, n long, keys binary, words binary, codes binary, sizes binary, ids binary"
_UNIT = [pa.int64(), pa.int64(), *[pa.binary()] * 5]


class Unit:
    """A unit's words as numbers; rows, their ids and word counts."""

    def __init__(self, words: bytes, codes: bytes, sizes: bytes, ids: bytes):
        self.words = zstandard.ZstdDecompressor().decompress(words).split(b"\n")
        self.codes = bloom.unpack(codes, np.uint32)
        self.sizes = bloom.unpack(sizes, np.uint32).astype(np.int64)
        self.ids = pa.ipc.open_stream(ids).read_all().column(0).combine_chunks()

    def numbers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, rows, doc ids and whether these are known, by word."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        row = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        return hashes[self.codes], row, self.ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(self.ids.is_valid())


def _changed(anchor: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Anchors that differ from the one before in their document."""
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
    return new


def _write_units(batches):
    task, count = TaskContext.get().partitionId(), 0
    words: dict[bytes, int] = {}
    ids, codes, size = [], [], 0

    def unit():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["doc_id"]))
        names = zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))
        body = [names, bloom.pack(np.concatenate(codes)), bloom.pack(np.array([len(c) for c in codes], np.uint32)), sink.getvalue().to_pybytes()]
        word, row, _, _ = Unit(*body).numbers()
        start = starts_of(row)
        anchor = anchors(word, row, start, Prints(word))
        anchor = anchor[_changed(anchor, row[start])]
        keys, n = bloom.pack_sorted(anchor), len(anchor)
        del word, row, start, anchor
        trim()
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([(task << 32) + count, n, keys, *body], _UNIT)], ["unit", "n", "keys", "words", "codes", "sizes", "ids"])

    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            split, put = (text or b"").split(), words.setdefault  # bytes.split() splits at ASCII white space
            codes.append(np.fromiter([put(w, len(words)) for w in split], np.uint32, len(split)))
            ids.append(doc)
            size += len(text or b"")
            if size >= UNIT_BYTES or len(ids) >= UNIT_ROWS:
                yield unit()
                count, words, ids, codes, size = count + 1, {}, [], [], 0
    if ids:
        yield unit()


# ---- settling ----
#: Kind 0: entries to settle, by part: fingerprints, doc ids, starts, lengths.  Kind 1: lost ranges of a unit.
SENT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("unit", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("own", pa.binary()), ("lo", pa.binary()), ("size", pa.binary())])
SENT_DDL = "part int, kind int, unit long, a binary, b binary, own binary, lo binary, size binary"


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(SENT)], schema=SENT)


def _lost(unit: int, lo: np.ndarray, size: np.ndarray) -> tuple:
    order = np.argsort(lo, kind="stable")
    return (-1, 1, unit, None, None, None, bloom.pack(np.diff(lo[order].astype(np.int64), prepend=0).astype(np.int64)), bloom.pack(size[order].astype(np.uint32)))


def _ranges(lo: bytes, size: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = np.cumsum(bloom.unpack(lo, np.int64))
    return at, at + bloom.unpack(size, np.uint32)


def _entries(unit: int, prints: Prints, lo: np.ndarray, hi: np.ndarray, own: np.ndarray, bits: int) -> list[tuple]:
    """Rows to settle; what a smaller doc_id of the same unit has is lost at once."""
    a, b = prints.of(lo, hi)
    order = np.lexsort((own, b, a))
    a, b, lo, size, own = a[order], b[order], lo[order], (hi - lo)[order], own[order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lost = own > own[head][np.cumsum(head) - 1] if len(a) else np.empty(0, bool)
    out = [_lost(unit, lo[lost], size[lost])] if lost.any() else []
    a, b, lo, size, own = (x[~lost] for x in (a, b, lo, size, own))
    part = (a >> U(64 - bits)).astype(np.int32)
    for i, j in bloom._runs(part):
        out.append((int(part[i]), 0, unit, bloom.pack(np.diff(a[i:j], prepend=U(0))), bloom.pack(b[i:j]), bloom.pack(own[i:j]), bloom.pack(lo[i:j].astype(np.uint32)), bloom.pack(size[i:j].astype(np.uint32))))
    return out


def _settle(batches):
    """Lost ranges by unit; rows come sorted by part."""

    def close(held):
        fields = [[bloom.unpack(h[k], t) for h in held] for k, t in ((1, np.uint64), (2, np.uint64), (3, np.int64), (4, np.uint32), (5, np.uint32))]
        a, b, own, lo, size = (np.concatenate(f) for f in ([np.cumsum(x, dtype=np.uint64) for x in fields[0]], *fields[1:]))
        source = np.repeat(np.arange(len(held)), [len(x) for x in fields[1]])
        order = np.lexsort((own, b, a))
        head = np.ones(len(a), bool)
        x, y = a[order], b[order]
        head[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        at = np.sort(order[own[order] > own[order][head][np.cumsum(head) - 1]])
        return [_lost(held[i][0], lo[at[p:q]].astype(np.int64), size[at[p:q]]) for p, q in bloom._runs(source[at]) for i in (int(source[at[p]]),)]

    now, held = None, []
    for batch in batches:
        through = []
        for part, kind, unit, *rest in zip(*(batch.column(c).to_pylist() for c in SENT.names)):
            if kind:
                through.append((part, kind, unit, *rest))
                continue
            if part != now and held:
                if out := close(held):
                    yield from _rows(out).to_batches()
                held = []
            now = part
            held.append((unit, *rest))
        if through:
            yield from _rows(through).to_batches()
    if held and (out := close(held)):
        yield from _rows(out).to_batches()


def _live(u: Unit, right: pa.Table, bits: int):
    """A unit's numbers, window starts, and which of these may be repeated."""
    word, row, ids, known = u.numbers()
    prints, start = Prints(word), starts_of(row)
    anchor = anchors(word, row, start, prints)
    new = _changed(anchor, row[start])
    asked = right.filter(pa.compute.greater_equal(right.column("part"), 0))
    mark = bloom.marked(anchor[new], bits, asked.column("part").to_pylist(), asked.column("maybe").to_pylist())
    live = mark[np.cumsum(new) - 1] & known[row[start]] if len(start) else np.empty(0, bool)
    return row, ids, prints, start, live


def _unit(t: pa.Table, i: int) -> Unit:
    return Unit(*(t.column(c)[i].as_py() for c in ("words", "codes", "sizes", "ids")))


def _send_symbols(bits: int, parts: int, ladder):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for i in range(left.num_rows):
            u = _unit(left, i)
            row, ids, prints, start, live = _live(u, right, bits)
            word = u.numbers()[0]
            lo, hi = high_symbols(word, row, ladder)
            # All windows of a symbol must be live: counted by a running sum over the starts.
            alive = np.zeros(len(word) + 1, np.int64)
            alive[start[live] + 1] = 1
            alive = np.cumsum(alive)
            whole = alive[hi - WINDOW + 1] - alive[lo] == hi - lo - WINDOW + 1
            lo, hi = lo[whole], hi[whole]
            out += _entries(left.column("unit")[i].as_py(), prints, lo, hi, ids[row[lo]] if len(lo) else ids[:0], parts)
            del u, row, ids, prints, start, live, word, lo, hi, alive, whole
            trim()
        return _rows(out)

    return run


def _send_windows(bits: int, parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for i in range(left.num_rows):
            u = _unit(left, i)
            row, ids, prints, start, live = _live(u, right, bits)
            gone = right.filter(pa.compute.less(right.column("part"), 0))
            # A window inside a lost symbol is not sent: the farthest end of the symbols that began by its start reaches past it.
            reach = np.zeros(len(row) + 1, np.int64)
            for lo, size in zip(gone.column("lo").to_pylist(), gone.column("size").to_pylist()):
                np.maximum.at(reach, *_ranges(lo, size))
            start = start[live & (np.maximum.accumulate(reach)[start] < start + WINDOW)]
            out += _entries(left.column("unit")[i].as_py(), prints, start, start + WINDOW, ids[row[start]] if len(start) else ids[:0], parts)
            del u, row, ids, prints, start, live, reach
            trim()
        return _rows(out)

    return run


def _apply(with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_by_symbol"] + ["kept_text"] * with_text
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()] + [pa.string()] * with_text

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i in range(left.num_rows):
            u = _unit(left, i)
            n = len(u.codes)
            cover = {}
            for symbol in (True, False):
                c = np.zeros(n + 1, np.int64)
                for lo, size, s in zip(*(right.column(x).to_pylist() for x in ("lo", "size", "symbol"))):
                    if s == symbol:
                        p, q = _ranges(lo, size)
                        np.add.at(c, p, 1)
                        np.add.at(c, q, -1)
                cover[symbol] = np.cumsum(c[:n]) > 0
            lost = cover[True] | cover[False]
            ends = np.cumsum(u.sizes)
            for doc, p, q in zip(u.ids.to_pylist(), (ends - u.sizes).tolist(), ends.tolist()):
                own = u.codes[p:q]
                gone = int(lost[p:q].sum())
                kept = b" ".join(map(u.words.__getitem__, (own[~lost[p:q]] if gone else own).tolist()))
                out.append((doc, q - p, gone, hashlib.sha256(kept).hexdigest(), int(cover[True][p:q].sum())) + ((kept.decode(),) if with_text else ()))
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return run


def substring_dedup(docs: DataFrame, with_text: bool = False, ladder=LADDER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_by_symbol (and kept_text) of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = written(rows.mapInArrow(_write_units, UNIT), bucket_by="unit", buckets=parts)
    n = units.agg(F.sum("n")).first()[0] or 0
    bits, pieces = bloom.part_bits(n, parts), bloom.part_bits(n * bloom.KEYS // ITEMS, parts)
    empty = [F.lit(None).cast("binary").alias(c) for c in ("lo", "size")]
    maybe = written(bloom.answers(units, bits, drop=16)).select("unit", "part", "maybe", *empty)
    bodies = units.select("unit", "words", "codes", "sizes", "ids").groupBy("unit")
    settled = lambda sent: written(sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_settle, SENT_DDL).select("unit", "lo", "size"))
    symbols_ = settled(bodies.cogroup(maybe.groupBy("unit")).applyInArrow(_send_symbols(bits, pieces, ladder), SENT_DDL))
    both = maybe.unionByName(symbols_.select("unit", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("maybe"), "lo", "size"))
    single = settled(bodies.cogroup(both.groupBy("unit")).applyInArrow(_send_windows(bits, pieces), SENT_DDL))
    lost = symbols_.withColumn("symbol", F.lit(True)).unionByName(single.withColumn("symbol", F.lit(False)))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_by_symbol long" + ", kept_text string" * with_text
    return bodies.cogroup(lost.groupBy("unit")).applyInArrow(_apply(with_text), schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("n_by_symbol")


SQL_OP2 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM s),
lost AS (SELECT DISTINCT doc_id, i + j AS p FROM f, range(0, 13) AS t(j) WHERE first < doc_id),
tok AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS text FROM tok ANTI JOIN lost USING (doc_id, p) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM lost GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
