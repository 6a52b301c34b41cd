"""A counting Bloom filter in parts: which 64-bit keys may occur at least twice.

No task and no driver holds the whole filter.  Keys are dealt to parts by their leading
bits, about KEYS keys a part; a unit of rows sends each part the next 32 bits of its keys,
sorted and packed.  A part counts hits in two halves of PER / 2 slots a key and answers each
unit with a bitmap: a key may be repeated if its slots of both halves were hit twice.  There
are no false negatives, and the share of false positives, about 1.4 percent of the single
keys at PER = 16, is the same at every size, as parts become more and not fuller.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from textloom.llm.common import shuffle_partitions
from textloom.llm.words import trim

KEYS = 500_000
PER = 16
U = np.uint64
MULTIPLIER = np.uint32(2654435769)


def pack(a: np.ndarray) -> bytes:
    """Numbers as zstandard-compressed byte planes."""
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(bytes([a.itemsize]) + planes.tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw[1:].reshape(int(raw[0]), -1).T).view(dtype).ravel()


def part_bits(n: int, least: int = 1) -> int:
    """Leading bits that name a key's part, for n keys and at least so many parts."""
    return int(np.ceil(np.log2(max(2, least, n / KEYS))))


def _runs(part: np.ndarray):
    """Slices of equal values of a sorted array."""
    cut = np.flatnonzero(part[1:] != part[:-1]) + 1
    return zip(np.append(0, cut).tolist(), np.append(cut, len(part)).tolist()) if len(part) else ()


def pack_sorted(u: np.ndarray, drop: int = 16) -> bytes:
    """Keys sorted and without their last bits, as differences: about three bytes a key.  The
    filter reads a part's leading bits and 32 more, so up to 2 ** 16 parts nothing changes."""
    return pack(np.diff(np.sort(u >> U(drop)), prepend=U(0)))


def _split(bits: int, drop: int | None):
    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for unit, body in zip(b.column("unit").to_pylist(), b.column("keys").to_pylist()):
                u = np.sort(unpack(body, U)) if drop is None else np.cumsum(unpack(body, U), dtype=U) << U(drop)
                part, rest = (u >> U(64 - bits)).astype(np.int32), (u >> U(32 - bits)).astype(np.uint32)
                rows += [(int(part[i]), unit, pack(np.diff(rest[i:j], prepend=np.uint32(0)))) for i, j in _runs(part)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["part", "unit", "hits"])

    return run


def twice(rest: np.ndarray) -> np.ndarray:
    """Which of a part's keys may occur twice."""
    bits = min(31, int(np.ceil(np.log2(max(2, PER // 2 * len(rest))))))
    out = np.ones(len(rest), bool)
    for x in (rest, rest * MULTIPLIER):
        slot = x >> np.uint32(32 - bits)
        out &= (np.bincount(slot, minlength=1 << bits) > 1)[slot]
    return out


def ranks(rest: np.ndarray) -> np.ndarray:
    """How often each of a part's keys occurs, as a rank: 1 for once, 7 more for each doubling."""
    order = np.argsort(rest, kind="stable")
    ends = [(i, j) for i, j in _runs(rest[order])]
    n = np.repeat([j - i for i, j in ends], [j - i for i, j in ends])
    out = np.empty(len(rest), np.uint8)
    out[order] = np.minimum(255, 1 + 7 * np.log2(n))
    return out


def _counts(batches, rank: bool):
    def close(part, units, packed):
        hits = [np.cumsum(unpack(x, np.uint32), dtype=np.uint32) for x in packed]
        found = np.split((ranks if rank else twice)(np.concatenate(hits)), np.cumsum([len(h) for h in hits])[:-1])
        rows = [(u, part, pack(m) if rank else np.packbits(m, bitorder="little").tobytes()) for u, m in zip(units, found) if rank or m.any()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["unit", "part", "maybe"])

    now, units, packed = None, [], []
    for b in batches:
        for part, unit, hits in zip(*(b.column(c).to_pylist() for c in ("part", "unit", "hits"))):
            if part != now and units:
                yield close(now, units, packed)
                units, packed = [], []
            now = part
            units.append(unit)
            packed.append(hits)
    if units:
        yield close(now, units, packed)


def _count(batches):
    yield from _counts(batches, False)
    trim()


def _rank(batches):
    yield from _counts(batches, True)
    trim()


def answers(units: DataFrame, bits: int, rank: bool = False, drop: int | None = None) -> DataFrame:
    """(unit, part, maybe) for units(unit, keys: packed uint64): bitmaps over the unit's sorted
    keys, or with rank a byte a key that says how frequent it is.  With drop, keys are those of
    ``pack_sorted``."""
    sent = units.select("unit", "keys").mapInArrow(_split(bits, drop), "part int, unit long, hits binary")
    return sent.repartition(shuffle_partitions(units.sparkSession), "part").sortWithinPartitions("part").mapInArrow(_rank if rank else _count, "unit long, part int, maybe binary")


def marked(u: np.ndarray, bits: int, parts: list[int], bitmaps: list[bytes], rank: bool = False) -> np.ndarray:
    """Which of a unit's keys may be repeated, or their ranks, by its answers."""
    order = np.argsort(u, kind="stable")
    part = (u[order] >> U(64 - bits)).astype(np.int32)
    out, by_part = np.zeros(len(u), np.uint8 if rank else bool), dict(zip(parts, bitmaps))
    for i, j in _runs(part):
        if (bitmap := by_part.get(int(part[i]))) is not None:
            out[i:j] = unpack(bitmap, np.uint8) if rank else np.unpackbits(np.frombuffer(bitmap, np.uint8), count=j - i, bitorder="little")
    back = np.empty_like(out)
    back[order] = out
    return back
