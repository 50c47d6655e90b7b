"""What the operators of this subpackage share: shared storage, Arrow text chunks, hashing, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one vectorised step handles; a longer single document is one step.
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to a Python worker while a table is written; a longer row is one batch.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_paths: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` or the context's; a new one of this machine's in local mode only."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="roadloom-"))
        set_to = spark.sparkContext.getCheckpointDir()
    return set_to.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/roadloom-{name}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_clean)
    _paths.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for spark, path in _paths:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001, S112  the session may be gone
            continue


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Bounds the bytes of Arrow batches of what runs inside; the session's own setting holds again afterwards."""
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, size)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def stored(df: DataFrame, name: str, batch: int = BATCH_BYTES) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession, batch):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table that stored() wrote and that nothing reads any more."""
    drop_path(df.sparkSession, df.stored_at)


_libc: list[Callable] = []


def _settle() -> None:
    """Arrow memory from the C library, so that what is freed can go back."""
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())


def release() -> None:
    """Gives freed memory back to the machine, where the C library can."""
    _powers.clear()
    if not _libc:
        try:
            _libc.append(ctypes.CDLL(None).malloc_trim)
        except (AttributeError, OSError):
            _libc.append(int)
    _libc[0](0)


def lean(run: Callable) -> Callable:
    """A function for mapInArrow whose worker keeps no freed memory between its tasks."""

    @functools.wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _settle()
        try:
            yield from run(batches)
        finally:
            release()

    return outer


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def raw_text(column: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; null is empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string array without nulls; no copy for 32-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def steps(column: pa.Array, most: int = STEP_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole texts, about ``most`` bytes and at most ``rows`` texts each."""
    data, at = buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


# --- hashing -----------------------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inverse" if inverse else "plain"
    if key not in _powers or len(_powers[key]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.full(size, BASE_INVERSE if inverse else BASE, dtype=np.uint64)
        out[0] = 1
        _powers[key] = np.multiply.accumulate(out)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _class(pattern: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(pattern, dtype=np.uint8)] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a word of ``[^\x20\x09-\x0D]+``.
SPACES = _class(b" \t\n\x0b\x0c\r")
#: Bytes that end a word of letters: all of ASCII but a-z (and A-Z, once in lower case).
NOT_LETTER = _class(bytes([*range(0x61), *range(0x7B, 0x80)]))
#: Bytes that end a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NOT_ALNUM = _class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def word_spans(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~ends[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over random byte values, mixed."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data)), out=total[1:])
    return mix((total[stops] - total[starts]) * powers(len(data) + 1, inverse=True)[starts] + (stops - starts).astype(np.uint64))


# --- connected components ------------------------------------------------------------------------


#: Edges (16 MB) that one task joins; larger tables take rounds over all executors.
FEW_EDGES = 1 << 20


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges u-v, each once, and the smallest node reachable from each.

    Roots hook to their smallest neighbour and edges are drawn between roots again: two rounds at least halve a component's roots.
    """
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(names))
    a, b = at[: len(u)], at[len(u) :]
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return names, names[root]


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of the nodes of all of a task's edges."""
    parts = [(batch.column("u").to_numpy(), batch.column("v").to_numpy()) for batch in batches if batch.num_rows]
    if parts:
        node, label = smallest_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.record_batch({"node": pa.array(node, pa.int64()), "label": pa.array(label, pa.int64())})


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60, few: int | None = None) -> DataFrame:
    """(node, label): the smallest node reachable over undirected edges between longs; nodes without an edge are absent.

    Up to ``few`` distinct edges (FEW_EDGES by default) are joined by one task, as rounds have thousands of tasks, of which each
    costs the driver memory. Of more, large-star and small-star rounds over the edge table (Kiveris et al., 2014): each is an
    aggregate and a join, the table shrinks to stars, every round is written to the shared folder. A hub's edges are split by AQE.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    known = _fingerprint(now)
    if known[0] <= (FEW_EDGES if few is None else few):
        labels = stored(now.coalesce(1).mapInArrow(lean(_labels), "node long, label long"), "labels")
        forget(now)
        return labels
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(down, "u")
        small = linked.select("u", F.col("m").alias("v")).union(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = stored(small, "edges")
        told = _fingerprint(after)
        if told == known:
            break
        forget(now)
        now, known = after, told
    else:
        raise RuntimeError(f"components: no fixpoint after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20).cast("decimal(38,0)"))).first())
