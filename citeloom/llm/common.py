"""Helpers shared by the corpus operators: words, hashing, materialisation, ranks."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_serial = itertools.count()
_tables: list[str] = []


def tidy(run):
    """A function over Arrow batches that gets a thousand rows at a time and, when its task ends, hands freed memory back.

    Python workers live on from task to task; what the C library keeps for later would add up.
    """

    def wrapped(batches):
        yield from run(b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000))
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return wrapped


def utf8(column) -> list[bytes | None]:
    """An Arrow string column as a list of UTF-8 bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ones of 64-bit hashes, ascending; each hash's place among them; positions by hash, then in order; where each distinct one begins there.

    Positions replace the last digits of the hashes, spread over all 64, so numbers are sorted, which is
    several times faster than sorting positions. The few hashes that agree in all other digits are then put
    right; if they are not few, positions are sorted.
    """
    n = len(x)
    if not n:
        return x, *[np.empty(0, np.int64)] * 3
    low, digits = x.min(), np.uint64(n.bit_length())
    spread = np.uint64(64 - int(x.max() - low).bit_length())
    sorted_ = ((x - low) << spread) if spread < 64 else np.zeros(n, np.uint64)
    sorted_ >>= digits
    sorted_ <<= digits
    sorted_ |= np.arange(n, dtype=np.uint64)
    sorted_.sort()
    order = (sorted_ & ((np.uint64(1) << digits) - np.uint64(1))).view(np.int64)
    values = x[order]
    wrong = np.flatnonzero(values[1:] < values[:-1])
    if len(wrong) > n // 256:
        order = np.argsort(x, kind="stable")
        values = x[order]
    elif len(wrong):
        sorted_ >>= digits
        for digit in np.unique(sorted_[wrong]):
            i, j = np.searchsorted(sorted_, digit), np.searchsorted(sorted_, digit, "right")
            order[i:j] = order[i:j][np.argsort(values[i:j], kind="stable")]
            values[i:j] = x[order[i:j]]
    new = np.ones(n, bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    starts, place = np.flatnonzero(new), np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return values[starts], place, order, starts


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of n words (of the whole sequence if it is shorter)."""
    n = min(n, len(h))
    if n == 0:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    rest = len(out)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for i in range(n):
        out = out * factor + h[i : i + rest]
    return mix64(out + np.uint64(n))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0xD1342543DE82EF95
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of _STEP and of its inverse modulo 2**64, n at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=np.uint64)
    return _powers


class Words:
    """Words of texts, A-Z lower case, found and hashed all at once: no object for each word.

    buffer holds the texts one after the other; word i is buffer[start[i]:end[i]], hash[i] its 64-bit
    hash, and text t has the words from first[t] to first[t + 1].
    """

    def __init__(self, texts: list[bytes | None]):
        self.buffer = b"\n".join([t or b"" for t in texts]).lower() + b"\n"
        raw = np.frombuffer(self.buffer, np.uint8)
        space = _SPACE[raw]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            change = np.concatenate([[0], change])
        self.start, self.end = change[::2], change[1::2]
        powers, inverse = _power_tables(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * powers[: len(raw)], dtype=np.uint64, out=total[1:])
        self.hash = mix64((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        stops = np.cumsum([len(t or b"") + 1 for t in texts])
        self.first = np.concatenate([[0], np.searchsorted(self.start, stops)]).astype(np.int64)


def pieces_of(texts: list[bytes | None], size: int = 1_000_000):
    """(from, to) of runs of texts of about `size` bytes."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t or b"") + 1
        if held >= size:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local master where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="citeloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/citeloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str = "t", done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again.

    The files survive the loss of executors. `done` are earlier tables that nothing reads any more: they
    are deleted, and with them, once the JVM has forgotten their plans, the shuffle files behind them.
    release() removes the rest.
    """
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{next(_serial)}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    _drop(spark, done)
    return out


def _drop(spark: SparkSession, done: tuple[DataFrame, ...]) -> None:
    for x in done:
        if getattr(x, "_written", None):
            _delete(spark, x._written)


def materialize_dealt(df: DataFrame, key: str, n: int, name: str = "t", done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """As materialize(), dealt to n buckets by a hash of `key`: grouping by it, or a union of such tables, shuffles nothing again."""
    spark = df.sparkSession
    serial = f"{name}_{next(_serial)}_{uuid.uuid4().hex[:8]}"
    path, table = f"{_root(spark)}/{serial}", f"citeloom_{serial}"
    dealt = df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", path)
    dealt.saveAsTable(table, format="parquet")
    _tables.append(table)
    out = spark.table(table)
    out._written = path
    _drop(spark, done)
    return out


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now, not when its memory is full.

    It does so when the JVM collects their plans; the last job's is only let go by the next, so an empty
    one runs first.
    """
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete everything that materialize() and materialize_dealt() wrote for this application."""
    while _tables:
        spark.sql(f"drop table if exists {_tables.pop()}")
    _delete(spark, _root(spark))


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, n_rows: int, per_bucket: int = 50_000, ties: str | None = None) -> DataFrame:
    """Gapless rank from 0 within keys, without gathering a key in one task.

    Rows are dealt to hash buckets within each key; a bucket's rank starts where the buckets before
    it end. Rows equal in `order` fall into one bucket and are ranked arbitrarily among themselves; `ties`
    names a column for their number, from 0.
    """
    buckets = max(1, -(-n_rows // per_bucket))
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate([*keys, "_bucket"])], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = b.withColumn("_local", F.row_number().over(own) - 1)
    if ties:
        local = local.withColumn(ties, (F.col("_local") + 1 - F.rank().over(own)).cast("int"))
    on = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate([*keys, "_bucket"])]
    joined = local.join(starts, on, "inner")
    return joined.select(*df.columns, *([ties] if ties else []), (F.col("_start") + F.col("_local")).cast("long").alias(out))
