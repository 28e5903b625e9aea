"""What the operators of this subpackage share: shared folders, sizes, packed rows, blocks of documents."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written  # noqa: F401

U = np.uint64
ODD = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later stages don't depend on any executor."""
    return written(df, name)


def bounded_batches(df: DataFrame) -> None:
    """Arrow batches of a few megabytes, for both sides of a Python worker hold several at a time. What the session sets
    itself stays; a DataFrame that is returned unevaluated has no settings of its own, so these stay as well."""
    own = df.sparkSession._jsparkSession.sessionState().conf()
    for name, value in (("maxRecordsPerBatch", "2000"), ("maxBytesPerBatch", str(4 << 20))):
        if not own.contains(f"spark.sql.execution.arrow.{name}"):
            df.sparkSession.conf.set(f"spark.sql.execution.arrow.{name}", value)


#: What a table of unknown size, one that isn't read from files, counts for: a gigabyte. Write a larger one to files first.
UNKNOWN = 1 << 30


def plan_bytes(df: DataFrame) -> int:
    """The size of the tables that df reads, as Catalyst knows it (for files, their size), without reading them.

    The estimate for df itself isn't used: Catalyst takes a join for a product, and a text for twenty bytes.
    """
    leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for k in range(leaves.size()):
        size = int(str(leaves.apply(k).stats().sizeInBytes()))
        total += size if size < 1 << 60 else UNKNOWN
    return total


def parts_for(df: DataFrame, target: int, least: int = 96) -> int:
    """How many parts of about target bytes df has; enough of them to spread over the cluster."""
    return int(max(least, plan_bytes(df) // target))


def string_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a column; null is empty, and bytes that aren't UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows one after another, and len + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A large_binary array of consecutive pieces of data."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def spans_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all the elements of [start, start + length), one span after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """The elements of [start, start + length), one span after another; indexes are made for about `most` at a time."""
    out = np.empty(int(lengths.sum()), data.dtype)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        out[done : int(ends[to - 1])] = data[spans_index(starts[at:to], lengths[at:to])]
        at = to
    return out


def trim() -> None:
    """Give memory that was freed back to the system: workers are kept, and what they once needed would stay with them."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def trimmed(function):
    """A function of one group, or of a key and a group, or of two groups, that trims when it is done."""
    import functools

    def one(a):
        try:
            return function(a)
        finally:
            trim()

    def two(a, b):
        try:
            return function(a, b)
        finally:
            trim()

    return functools.wraps(function)(one if function.__code__.co_argcount == 1 else two)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: their bytes plane by plane, which leaves long runs in sorted or small numbers."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sQ", data, at)
        at += 10
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(data, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += size * dtype.itemsize
    return out


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Part of a uniform 64-bit key; doesn't fall as the key grows."""
    return (((key >> U(32)) * U(parts)) >> U(32)).astype(np.int32)


# ---- blocks: whole rows of documents, dealt by id into blocks that any later stage can ask for again

BLOCK_SCHEMA = "block int, rows binary"
#: Bytes of rows that a task deals out at a time.
GATHER_BYTES = 12 << 20


def block_of(doc_id: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(blocks)).cast("int")


def to_blocks(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, rows): the rows of df as compressed Arrow, many to a value. Rows with the same key are in the same block."""
    name = "__block"
    while name in df.columns:
        name += "_"
    bounded_batches(df)
    keyed = df.withColumn(name, block_of(F.col(key), blocks))

    def gathered(batches):
        """Batches put together to some megabytes, so that a block's share of one isn't tiny."""
        some, size = [], 0
        for batch in batches:
            some.append(batch)
            size += batch.nbytes
            if size >= GATHER_BYTES:
                yield pa.Table.from_batches(some).combine_chunks()
                some, size = [], 0
        if some:
            yield pa.Table.from_batches(some).combine_chunks()

    def run(batches):
        option = pa.ipc.IpcWriteOptions(compression="zstd")
        for rows in gathered(batches):
            block = rows.column(name).to_numpy()
            rows = rows.drop_columns([name])
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=option) as w:
                    w.write_table(rows.take(pa.array(own)))
                yield pa.RecordBatch.from_arrays([pa.array([int(block[own[0]])], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])
            del rows, order
        trim()

    return keyed.mapInArrow(run, BLOCK_SCHEMA)


def from_blocks(values: pa.ChunkedArray) -> pa.Table:
    """The rows of one block, in an order that doesn't depend on how they arrived."""
    found = [pa.ipc.open_stream(x.as_py()).read_all() for x in values]
    return pa.concat_tables(found).combine_chunks()
