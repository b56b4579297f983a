"""Helpers shared by the operators: bounded chunks of text, crc buckets, hashed lookups."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at once; a single longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per application, for sessions that were started without it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tenantlake-code-")) / f"{root.name}-code.zip"  # read by the driver alone
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text``, nothing else: other columns can't clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def unused_name(df: DataFrame, wanted: str) -> str:
    """A column name the frame doesn't have yet, whatever extra columns it carries."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % F.lit(modulus)


def as_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, empty for null."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def as_text(array: pa.Array) -> list[str]:
    return [x or "" for x in array.to_pylist()]


def chunks(texts: list, limit: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``limit`` bytes each, and of ``rows`` texts at most."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit or i - start == rows:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


class HashIndex:
    """Positions of distinct 64-bit keys by vectorised open addressing; -1 for a key that isn't there."""

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.keys = np.zeros(0, np.uint64)
        self.add(keys)

    def add(self, keys: np.ndarray) -> None:
        """Further distinct keys, at the positions after those there are."""
        keys = np.ascontiguousarray(keys, np.uint64)
        old = len(self.keys)
        self.keys = np.concatenate((self.keys, keys))
        if not old or 2 * len(self.keys) > len(self.place):
            bits = max(4, int(max(1, len(self.keys)) * 3 - 1).bit_length())
            self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
            self.place = np.full(1 << bits, -1, np.int32)
            old = 0
        todo = np.arange(old, len(self.keys), dtype=np.int32)
        slot = self._slots(self.keys[old:])
        while len(todo):
            free = self.place[slot] < 0
            self.place[slot[free]] = todo[free]
            left = self.place[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self._MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        keys = np.ascontiguousarray(keys, np.uint64)
        slot = self._slots(keys)
        out = self.place[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            got = self.place[slot]
            out[todo] = got
            again = (got >= 0) & (self.keys[got] != keys[todo])
            todo, slot = todo[again], slot[again]
        return out


_BASE = 0x9DDFEA08EB382D69
_powers: list[np.ndarray] = []


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` for many slices at once, from one running sum."""
    n = len(data)
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, 2 * CHUNK_BYTES)
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))))
                      for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    up, down = _powers
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    out = (total[ends] - total[starts]) * down[starts]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out
