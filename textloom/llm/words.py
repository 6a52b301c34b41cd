"""Words of texts as 64-bit numbers, for operators that work on numpy arrays."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64

_WORDS: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def parse(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a batch of texts, the row of each, and each row's first word."""
    known, digest = _WORDS, xxhash.xxh3_64_intdigest
    if len(known) > 200_000:  # bounds the memory of a Python worker
        known.clear()
    parts = []
    for t in texts:
        split = (t or b"").split()
        for w in set(split):
            if w not in known:
                known[w] = digest(w)
        parts.append(np.fromiter(map(known.__getitem__, split), np.uint64, len(split)))
    sizes = np.array([len(p) for p in parts], np.int64)
    word = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return word, np.repeat(np.arange(len(parts), dtype=np.int32), sizes), np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)


def trim() -> None:
    """Gives memory that a unit's arrays took back to the system; Python workers live on and
    would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()  # Arrow's allocator keeps pages of its own
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(f):
    """f, a function of an Arrow operator, that leaves its worker as small as it found it: what a
    task held, known words too, goes back to the system when f ends."""

    def end() -> None:
        _WORDS.clear()
        trim()

    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def run(batches):
            yield from f(batches)
            end()

    else:

        @functools.wraps(f)
        def run(*tables):
            out = f(*tables)
            end()
            return out

    # PySpark reads the number of arguments from the signature.
    run.__signature__ = inspect.signature(f)
    return run
