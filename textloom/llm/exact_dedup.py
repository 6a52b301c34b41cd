"""Exact deduplication by two-pass Bloom filtering.

Pass 1 hashes every whole text once (SHA-256 of the UTF-8 text with A-Z lower-cased)
and adds each hash to a counting Bloom filter whose slots remember "hit once" and "hit
twice or more".  Pass 2 probes: only rows all of whose slots were hit at least twice are
possibly repeated, and only those rows shuffle (by hash, without their texts).  All other
rows pass straight through.

The filter is kept in parts (``bloom``): units of rows send 32 bits a hash and get a
bitmap back, so that neither the filter nor its load grows in any one place.  Digests are
written once, bucketed by unit, and meet their unit's bitmap without a shuffle.

Defined results: a null text counts as empty; a null doc_id sorts below all
others; of rows with equal doc_id and text exactly one stays; an empty table
gives an empty result; extra columns are ignored by ``exact_groups`` and kept by
``exact_dedup``; a very long text is hashed whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import bloom
from textloom.llm.common import attach, keep_rows, row_key, shuffle_partitions, small_batches, table, written

#: Rows of a unit; a unit's digests are about 1.3 MB.
UNIT_ROWS = 20_000
ROW = pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("sha", pa.string()), ("__k1", pa.int64()), ("__k2", pa.int64())])
ROW_DDL = "doc_id long, row_id long, sha string, __k1 long, __k2 long"


def _digest(batches):
    """Units: (unit, n, keys, body); the body holds the digests as Arrow rows."""
    task, count, held = TaskContext.get().partitionId(), 0, []

    def unit(rows):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(rows)
        keys = np.array([int(x[:16], 16) for x in rows.column("sha").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([pa.array([(task << 32) + count]), pa.array([len(keys)]), pa.array([bloom.pack(keys)], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["unit", "n", "keys", "body"])

    for b in batches:
        raw = [hashlib.sha256((t or b"").lower()).hexdigest() for t in b.column("text").cast(pa.binary()).to_pylist()]  # bytes.lower() touches A-Z only
        held.append(pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_id"), pa.array(raw, pa.string()), b.column("__k1"), b.column("__k2")], schema=ROW))
        if sum(h.num_rows for h in held) >= UNIT_ROWS:
            yield unit(pa.Table.from_batches(held))
            count, held = count + 1, []
    if any(h.num_rows for h in held):
        yield unit(pa.Table.from_batches(held))


def _probe(bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts, bitmaps = right.column("part").to_pylist(), right.column("maybe").to_pylist()
        out = []
        for keys, body in zip(left.column("keys").to_pylist(), left.column("body").to_pylist()):
            maybe = bloom.marked(bloom.unpack(keys, np.uint64), bits, parts, bitmaps)
            out.append(pa.ipc.open_stream(body).read_all().append_column("maybe", pa.array(maybe)))
        return pa.concat_tables(out) if out else ROW.append(pa.field("maybe", pa.bool_())).empty_table()

    return run


def probed(docs: DataFrame) -> DataFrame:
    """A row for each row of docs(doc_id, text): ids, digest, row key, and maybe: its text may be repeated."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(k) for k, c in row_key().items()]).withColumn("row_id", F.monotonically_increasing_id())
    units = written(rows.mapInArrow(_digest, "unit long, n long, keys binary, body binary"), bucket_by="unit", buckets=shuffle_partitions(spark))
    n = units.agg(F.sum("n")).first()[0] or 0
    bits = bloom.part_bits(n, shuffle_partitions(spark))
    found = bloom.answers(units, bits)
    return units.groupBy("unit").cogroup(found.groupBy("unit")).applyInArrow(_probe(bits), ROW_DDL + ", maybe boolean")


def repeats(rows: DataFrame) -> DataFrame:
    """The possibly repeated rows with keep (doc_id, row_id) and group_size.  A hot group is
    summed and joined by (hash, salt), never in one task."""
    return attach(rows.where("maybe"), ["sha"], {"top": F.max(F.struct("doc_id", "row_id")), "n": F.count("*")}, {"keep": F.max("top"), "group_size": F.sum("n")}, "row_id")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, row_id, keep_id, group_size, kept, text_sha256 of each row of docs(doc_id, text)."""
    rows = written(probed(docs))
    alone = rows.where("not maybe").select("doc_id", "row_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    found = repeats(rows).select("doc_id", "row_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.row_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(found)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs (all columns) that stay: one of each group of equal texts.  Rows whose
    text is not repeated pass straight through; texts are never shuffled."""
    again = repeats(written(probed(docs).where("maybe"))).where("group_size > 1")
    return keep_rows(docs, again.select("__k1", "__k2", (F.col("row_id") == F.col("keep.row_id")).alias("kept")))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("row_id")


SQL_OP6 = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
