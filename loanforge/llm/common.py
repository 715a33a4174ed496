"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loanforge.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, drop_shuffle: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder (``spark.checkpoint.dir``) and read it back.

    What follows reads files, so a lost executor costs no recomputation.
    ``drop_shuffle`` has Spark delete the shuffle files of this write when it ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    if drop_shuffle:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(conf).delete(path, True)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts in a batch between executor and Python; both hold it, the executor twice while it grows.
TEXT_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to ``TEXT_ROWS``; a setting below that stays.

    What reads texts is run by whoever writes its result, so the setting can't be put back here.
    """
    rows = int(spark.conf.get(ARROW_ROWS, "10000"))
    if rows <= 0 or rows > TEXT_ROWS:
        spark.conf.set(ARROW_ROWS, str(TEXT_ROWS))


#: What this Python worker holds beyond a task, by operator, as the function that frees it.
HELD: dict[str, Callable[[], None]] = {}


def working_for(operator: str | None = None) -> None:
    """Frees what the worker holds for other operators: workers serve many stages, memory is for the one at work."""
    for name in [x for x in HELD if x != operator]:
        HELD.pop(name)()
        pa.default_memory_pool().release_unused()


def batches(fn: Callable[[list], pa.RecordBatch], rows: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``mapInArrow`` function that hands on slices of at most ``rows`` rows, so that long texts stay few in memory."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for()
        for b in it:
            for i in range(0, b.num_rows, rows):
                yield fn(b.slice(i, rows))

    return run


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array and the offsets of its rows; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], dtype=kind, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(it: Iterator[pa.RecordBatch], column: int, rows: int = 512, limit: int = 2 << 20, operator: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about ``limit`` bytes of text, or of listed integers, in ``column``, one row at least."""
    working_for(operator)
    for b in it:
        x = b.column(column)
        size = pc.multiply(pc.list_value_length(x), 4) if pa.types.is_list(x.type) else pc.binary_length(x)
        ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < b.num_rows:
            before = ends[i - 1] if i else 0
            j = min(max(i + 1, int(np.searchsorted(ends, before + limit, side="right"))), i + rows, b.num_rows)
            yield b.slice(i, j - i)
            i = j


_RANDOM = np.random.default_rng(7)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def word_table(low: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, 64-bit hash and row of every word of the joined texts; ``inside``: which bytes belong to words."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = np.unique(offsets[(offsets > 0) & (offsets < len(low))])
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return start, end, np.zeros(0, np.uint64), start
    at = np.flatnonzero(inside)
    lengths = end - start
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(begin, lengths)
    value = _BYTE[low[at]] * (_PLACE[place & 63] + (place >> 6).astype(np.uint64) * _PLACE[0])
    value ^= value >> np.uint64(29)
    h = np.add.reduceat(value, begin) + lengths.astype(np.uint64)
    return start, end, h, np.searchsorted(offsets, start, side="right") - 1
