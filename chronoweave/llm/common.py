"""Helpers shared by the training-data operators.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir`` as
Parquet, so a lost executor only costs the tasks it ran.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators of words in the contracts: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_IS_SEP = np.zeros(256, bool)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set (tests)."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = path or tempfile.mkdtemp(prefix="chronoweave-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and is computed once."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 500, size: str = "4m", group: int = 8 << 20) -> None:
    """Smaller batches between the JVM and Python, and row groups of files, unless the session has settings of its own.

    Texts are long rows: the usual 10,000 of a batch are held on both sides several times over, and
    a writer of Parquet holds its row group (usually 128 MB, so the whole output of a task).
    """
    if spark.conf.get("parquet.block.size", None) is None and spark.sparkContext._jsc.hadoopConfiguration().get("parquet.block.size") is None:
        spark.conf.set("parquet.block.size", str(group))
    for key, usual, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", size)):
        if spark.conf.get(key) == usual:
            spark.conf.set(key, value)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint if the (already written) table has at most ``max_rows`` rows.

    Beyond the bound the plain table is returned and Spark shuffles the join.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def sized(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """``df`` in as many tasks as ``rows`` need; small tables then don't cost a task per shuffle partition."""
    return df.coalesce(max(1, -(-rows // each)))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def per_batch(fn: Callable) -> Callable:
    """``mapInPandas`` body that applies ``fn`` to each non-empty frame."""

    def body(frames):
        for frame in frames:
            if len(frame):
                yield fn(frame)

    return body


def slices(sizes: np.ndarray, limit: int):
    """(first, past) row ranges whose sizes sum to about ``limit`` at most; a row is never cut."""
    first, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > first and total + n > limit:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


_CLAIMED: dict[str, object] = {}


def claim(owner: str, build: Callable | None = None):
    """What ``build`` made for ``owner`` in this Python process, made once.

    Workers are used again by later operators: at another owner's first call the memory of the
    one before is given back to the system, caches of the libraries included.
    """
    if owner not in _CLAIMED:
        _CLAIMED.clear()
        give_back()
        _CLAIMED[owner] = build() if build else None
    return _CLAIMED[owner]


def tidy(body: Callable) -> Callable:
    """``body`` of rows that gives free memory back when its rows have ended.

    A worker without a task stays in its executor for minutes, with all that it ever took.
    """

    def run(frames):
        yield from body(frames)
        give_back()

    return run


def give_back() -> None:
    """Return free memory of this process to the system."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def whole_groups(frames, keys: list[str]):
    """One frame per group, of frames sorted by ``keys``; a group may span frames."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        k = frame[keys].to_numpy()
        if held and (held[-1][keys].iloc[-1].to_numpy() != k[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        cut = (np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist()
        for a, b in zip([0, *cut], cut):
            yield pd.concat([*held, frame.iloc[a:b]], ignore_index=True)
            held = []
        held.append(frame.iloc[cut[-1] if cut else 0 :])
    if held:
        yield pd.concat(held, ignore_index=True)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (published constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    """The first ``n`` values of a seeded splitmix64 stream."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_POSITION = [stream64(1 << 12, 77) | np.uint64(1)]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit multilinear hashes of the runs ``values[starts:ends]`` (all non-empty, ascending)."""
    longest = int((ends - starts).max()) if len(starts) else 0
    if longest > len(_POSITION[0]):
        _POSITION[0] = stream64(1 << (longest - 1).bit_length(), 77) | np.uint64(1)
    lengths = (ends - starts).astype(np.int32)
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths, dtype=np.int32) - lengths
    total = int(first[-1] + lengths[-1])
    if total == len(values):
        body = values.astype(np.uint64)
    else:
        step = np.ones(total, np.int32)
        step[0] = starts[0]
        step[first[1:]] = starts[1:] - ends[:-1] + 1
        body = values[np.cumsum(step, dtype=np.int32)].astype(np.uint64)
    step = np.ones(total, np.int32)
    step[0] = 0
    step[first[1:]] = 1 - lengths[:-1]
    body += np.uint64(1)
    body *= _POSITION[0][np.cumsum(step, dtype=np.int32)]
    return mix64(np.add.reduceat(body, first) ^ (lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def words_of(texts: list[bytes], block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 ``texts`` after lower-casing A-Z, and the count in each text."""
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    for a, b in slices(sizes, block):
        data = np.frombuffer(b"\x20".join([*texts[a:b], b""]), np.uint8)
        inside = ~_IS_SEP[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        hashes.append(run_hashes(_LOW[data], starts, ends))
        counts[a:b] = np.diff(np.searchsorted(starts, np.cumsum(sizes[a:b])), prepend=0)
    return np.concatenate(hashes), counts


class HashIndex:
    """Open-addressing map from 64-bit hashes to consecutive numbers, probed with array operations."""

    def __init__(self, capacity: int):
        self.mask = np.uint64((1 << (2 * capacity - 1).bit_length()) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.values = np.zeros(int(self.mask) + 1, np.int32)
        self.n = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where absent. Hash 0 counts as hash 1."""
        hashes = np.maximum(hashes, np.uint64(1))
        at = (hashes & self.mask).astype(np.int64)
        have = self.keys[at]
        hit = have == hashes
        out = np.where(hit, self.values[at], np.int32(-1))
        left = np.flatnonzero(~hit & (have != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(self.mask)
            have = self.keys[at[left]]
            hit = have == hashes[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (have != 0)]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Number new, distinct hashes on from the last number."""
        hashes = np.maximum(hashes, np.uint64(1))
        number = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        at = (hashes & self.mask).astype(np.int64)
        self.n += len(hashes)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            place, which = np.unique(at[free], return_index=True)
            won = free[which]
            self.keys[place], self.values[place] = hashes[won], number[won]
            done = np.zeros(len(hashes), bool)
            done[won] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & int(self.mask)
