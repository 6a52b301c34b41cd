"""BPE encoding and decoding through a distinct-word table.

1. Texts are split at ASCII white space into words.  Each block of documents
   gets a dictionary of its distinct words and, by position, codes into it.
2. The distinct words shuffle, packed by hash bucket; each bucket encodes each
   distinct word once and answers every block with the ids of its words.
3. Ids join back by position within each block.  Decoding joins each id with
   its piece and reproduces the library's decode(ids, skip_special_tokens=False):
   ``decode`` as a join of DataFrames; within ``encode`` as a hash join with the
   same table (id, piece), broadcast to the block's task, once for each distinct word
   of a block instead of once for each token.  The table is bounded by the tokenizer file.

Words may be encoded one by one only if the tokenizer never looks across white space.
``separable`` reads that from the tokenizer file: known normalisers, a first pre-tokenizer
that drops what its pattern doesn't match and whose pattern matches no white space, no
decoder, no added token with white space.  For any other file whole texts take the place
of words, with the library's own decoding.

Blocks are bounded by bytes and are written once to the
shared folder, bucketed by block: neither texts nor codes shuffle, only packed
distinct words and their ids do.  A bucket's table of words is bounded by ``KNOWN_BYTES``;
beyond that it starts anew and a word may be encoded again.

Defined results: a null or empty text has no tokens and decodes to an empty
text; documents are encoded row by row, so ties, null ids and repeated rows
each give their own row; an empty table gives an empty result; extra columns are ignored;
a text of over ``BLOCK_BYTES`` is a block of its own, held by one task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import shuffle_partitions, small_batches, table, written
from textloom.llm.words import trim, trimmed

BLOCK_BYTES = 16 << 20
KNOWN_BYTES = 64 << 20
PACKED = "block long, part int, kind int, body binary, ids binary"


def pack(a: np.ndarray) -> bytes:
    """uint32 numbers as zstandard-compressed byte planes."""
    planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["block", "part", "kind", "body", "ids"])


def separable(spec: str) -> bool:
    """Whether words between ASCII white space encode and decode independently."""
    j = json.loads(spec)
    flat = lambda x, inner: [] if x is None else [z for y in x[inner] for z in flat(y, inner)] if x["type"] == "Sequence" else [x]
    norms, pres = flat(j.get("normalizer"), "normalizers"), flat(j.get("pre_tokenizer"), "pretokenizers")
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in norms)
    first = pres[0] if pres else {}
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "Regex" in first.get("pattern", {})
    if not (plain and drops) or j.get("decoder") or j.get("post_processor"):
        return False
    if any(re.search(r"[\x20\x09-\x0D]", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in j.get("added_tokens", [])):
        return False
    # No look-around, and each alternative is made of letters, apostrophes or classes without white space.
    part = r"(?:[A-Za-z']|\\p\{[LN]\}|\[(?:\\p\{[LN]\})+\]|\[\^\\s(?:\\p\{[LN]\})*\])[+]?"
    return all(re.fullmatch(rf"(?:{part})+", x) for x in first["pattern"]["Regex"].split("|"))


def _pack_words(words: list[bytes]) -> bytes:
    return len(words).to_bytes(4, "little") + np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words)


def _unpack_words(b: bytes) -> list[bytes]:
    n = int.from_bytes(b[:4], "little")
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(b, "<u4", n, 4), dtype=np.int64)
    return [b[i:j] for i, j in zip(np.append(4 + 4 * n, ends[:-1]).tolist(), ends.tolist())]


def _blocks(parts: int, words_apart: bool):
    """Kind 0: the words of a block that fall in one hash bucket. Kind 1: the
    block's documents: ids, lengths, codes in order of first use, code order by bucket."""

    def run(batches):
        trim()  # a worker that another stage used
        task = TaskContext.get().partitionId()
        count = size = 0
        words: dict[bytes, int] = {}
        docs: list = []
        codes: list = []
        lengths: list[int] = []

        def flush():
            nonlocal count, size, words, docs, codes, lengths
            if not docs:
                return
            block = (task << 32) + count
            names = list(words)
            bucket = np.fromiter((zlib.crc32(w) % parts for w in names), np.uint32, len(names))
            order = np.argsort(bucket, kind="stable")
            z = zstandard.ZstdCompressor(level=1)
            cut = np.flatnonzero(np.diff(bucket[order])) + 1
            rows = [(block, int(bucket[g[0]]), 0, z.compress(_pack_words([names[i] for i in g.tolist()])), None) for g in np.split(order, cut) if len(g)]
            body = b"".join(len(p).to_bytes(4, "little") + p for p in (pack(np.array(lengths, np.uint32)), pack(np.concatenate(codes) if codes else np.empty(0, np.uint32)), pack(bucket)))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([pa.array(docs, pa.int64())], ["doc_id"]))
            rows.append((block, -1, 1, body, sink.getvalue().to_pybytes()))
            count, size, words, docs, codes, lengths = count + 1, 0, {}, [], [], []
            yield _batch(rows)
            trim()

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                split = ((text or b"").split() if words_apart else [text]) if text else []  # bytes.split() splits at ASCII white space
                put = words.setdefault
                codes.append(np.fromiter([put(w, len(words)) for w in split], np.uint32, len(split)))
                docs.append(doc)
                lengths.append(len(split))
                size += len(text or b"")
                if size >= BLOCK_BYTES or len(docs) >= 20_000:
                    yield from flush()
        yield from flush()

    return run


_TOKENIZERS: dict = {}


def tokenizer_of(text: str):
    """The tokenizers library's Tokenizer of a file's content; one a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (key := hash(text)) not in _TOKENIZERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(text)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[key] = t
    return _TOKENIZERS[key]


def _encode(spec):
    """Answers each kind 0 row; a word is encoded once in its bucket's task."""

    @trimmed
    def run(batches):
        t = tokenizer_of(spec.value)
        known: dict[bytes, np.ndarray] = {}
        held = 0
        for b in batches:
            for block, part, body in zip(b.column("block").to_pylist(), b.column("part").to_pylist(), b.column("body").to_pylist()):
                words = _unpack_words(zstandard.ZstdDecompressor().decompress(body))
                if held > KNOWN_BYTES:
                    known, held = {}, 0
                new = [w for w in words if w not in known]
                held += sum(len(w) + 150 for w in new)
                for i in range(0, len(new), 4096):
                    some = new[i : i + 4096]
                    for w, e in zip(some, t.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                        known[w] = np.array(e.ids, np.uint32)
                ids = [known[w] for w in words]
                yield _batch([(block, part, 0, pack(np.array([len(x) for x in ids], np.uint32)), pack(np.concatenate(ids)))])

    return run


def _join(spec, pieces, words_apart: bool, with_ids: bool):
    """Joins ids back by position: a block's answers (right) with its documents (left), and
    each id with its piece."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        piece = pieces.value
        right = right.sort_by("part")
        lens = [unpack(x) for x in right.column("body").to_pylist()]
        n = np.concatenate(lens) if lens else np.empty(0, np.uint32)
        flat = [unpack(x) for x in right.column("ids").to_pylist()]
        all_ids = (np.concatenate(flat) if flat else np.empty(0, np.uint32)).tolist()
        as_ids, as_text, start = [], [], 0
        for end in np.cumsum(n, dtype=np.int64).tolist():
            own = all_ids[start:end]
            as_ids.append(b" ".join([b"%d" % i for i in own]))
            as_text.append(b" ".join([piece[i] for i in own]) if words_apart else tokenizer_of(spec.value).decode(own, skip_special_tokens=False).encode())
            start = end
        empty = bool((n == 0).any())
        out = []
        for body, ids in zip(left.column("body").to_pylist(), left.column("ids").to_pylist()):
            at, parts = 0, []
            while at < len(body):
                k = int.from_bytes(body[at : at + 4], "little")
                parts.append(unpack(body[at + 4 : at + 4 + k]))
                at += 4 + k
            lengths, codes, bucket = parts
            place = np.empty(len(bucket), np.int64)
            place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
            codes = place[codes]
            docs = pa.ipc.open_stream(ids).read_all().column(0).to_pylist()
            start = 0
            for doc, k in zip(docs, lengths.tolist()):
                own = codes[start : start + k]
                start += k
                if empty:
                    own = own[n[own] > 0]
                c = own.tolist()
                text_ids = b" ".join(map(as_ids.__getitem__, c))
                decoded = b" ".join(map(as_text.__getitem__, c))
                row = (doc, int(n[own].sum()) if c else 0, hashlib.sha256(text_ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                out.append(row + ((np.array(text_ids.split(), np.int32),) if with_ids else ()))
        done = pa.Table.from_batches([_result(out, with_ids)])
        del out, as_ids, as_text, all_ids
        trim()
        return done

    return run


def _result(rows, with_ids):
    cols = list(zip(*rows))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)


def encode(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    apart = separable(text)
    spec = spark.sparkContext.broadcast(text)  # a vocabulary file, a few MB
    table_ = {r.id: r.piece.encode() for r in vocabulary(spark, tokenizer_path).where("piece is not null").toLocalIterator()}
    pieces = spark.sparkContext.broadcast(table_)  # a row for each id of the file
    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_blocks(parts, apart), PACKED)
    blocks = written(packed, bucket_by="block", buckets=parts)
    answers = blocks.where("kind = 0").repartition(parts, "part").mapInArrow(_encode(spec), PACKED)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return blocks.where("kind = 1").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_join(spec, pieces, apart, with_ids), schema)


def vocabulary(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """(id, piece) of a tokenizer file."""
    with open(tokenizer_path, encoding="utf-8") as f:
        t = tokenizer_of(f.read())
    return spark.createDataFrame([(i, t.id_to_token(i)) for i in range(t.get_vocab_size())], "id int, piece string")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of encoded(doc_id, ids): an id-to-piece join, then pieces in
    order.  The vocabulary is bounded by its file, so it is broadcast."""
    pieces = F.broadcast(vocabulary(encoded.sparkSession, tokenizer_path))
    keyed = encoded.withColumn("__row", F.monotonically_increasing_id())
    rows = keyed.select("__row", "doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    joined = rows.join(pieces, "id", "left").groupBy("__row", "doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))).alias("p"))
    return joined.select("doc_id", F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text"))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
