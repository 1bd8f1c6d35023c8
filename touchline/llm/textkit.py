"""Vectorised text primitives shared by the operators of this package.

They work on the byte buffers of an Arrow string column, so a batch of
documents is tokenised without making one Python string per word.  A word is
a run of ``[^\\x20\\x09-\\x0D]``; A-Z are lower-cased, all other bytes kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULT = U64(0x9E3779B97F4A7C15)
_POW = np.ones(1, dtype=U64)
_VALUE = np.where(SPACE, 0, np.arange(1, 257)).astype(U64)  # white space adds nothing to a word's hash

#: Bytes of text handled at a time inside a task; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed by place, and the new name of each, so
    that a stage's own columns cannot clash with those of its input."""
    names = {c: f"given_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def word_count(text: Column | str) -> Column:
    """Number of words of a text column (0 for null), on the JVM."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (starting at 0) of an Arrow string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (one row at least)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash multiplier modulo 2^64."""
    global _POW
    if len(_POW) < n:
        m = max(1024, 2 * n)
        step = np.full(m, _MULT, dtype=U64)
        step[0] = 1
        _POW = np.multiply.accumulate(step)
    return _POW[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def find_words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the word range of each document."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    on = ~space[data]
    before = np.empty_like(on)
    before[0] = False
    before[1:] = on[:-1]
    cut = offs[:-1][offs[:-1] < len(data)]
    before[cut] = False
    first = on & ~before
    starts = np.flatnonzero(first)
    after = np.empty_like(on)
    after[-1] = False
    after[:-1] = on[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(on & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    lens = ends - starts
    lo = int(starts[0])
    seg = np.diff(starts, append=ends[-1]).astype(np.int32)  # each word with the white space after it
    at = (starts - lo).astype(np.int32)
    place = np.arange(int(ends[-1]) - lo, dtype=np.int32)
    place -= np.repeat(at, seg)
    longest = int(lens.max())
    if int(seg.max()) > longest:
        np.minimum(place, longest - 1, out=place)
    val = _VALUE[data[lo:int(ends[-1])]]
    val *= powers(longest)[place]
    h = np.add.reduceat(val, at)
    return mix(h + lens.astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_sets(words: np.ndarray, word_offs: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Per document: sorted distinct hashes of its ``size``-word shingles; with
    fewer words the whole sequence is one shingle; no words: an empty set."""
    n = len(words)
    if n >= size:
        h = words[: n - size + 1].copy()
        for j in range(1, size):
            h = h * U64(0xC2B2AE3D27D4EB4F) + words[j: n - size + 1 + j]
        h = mix(h)
    else:
        h = np.zeros(0, U64)
    out = []
    for lo, hi in zip(word_offs[:-1].tolist(), word_offs[1:].tolist(), strict=True):
        if hi - lo >= size:
            s = np.sort(h[lo: hi - size + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif hi > lo:
            v = U64(hi - lo)
            with np.errstate(over="ignore"):
                for x in words[lo:hi]:
                    v = v * U64(0xC2B2AE3D27D4EB4F) + x
            out.append(mix(np.array([v ^ U64(0x5851F42D4C957F2D)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def documents(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of a text column: first and last row, lower-cased bytes, offsets."""
    raw, offs = buffers(col)
    for lo, hi in chunks(offs, limit):
        yield lo, hi, LOWER[raw[offs[lo]:offs[hi]]], offs[lo:hi + 1] - offs[lo]


def binary_array(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())
