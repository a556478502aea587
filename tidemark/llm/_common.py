"""What the operators of this subpackage share: tables in the shared folder, ranks, joins, byte batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Largest table, as rows times an assumed width, that a join may broadcast.
BROADCAST_BYTES = 8 << 20

#: Rows and bytes of an Arrow batch.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}

#: Bytes of text that one numpy step works on; arrays of eight bytes a position stay small beside it.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Where that is unset, a local
    master (as in tests) gets a temporary folder; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs no more than the stage that it ran.  The files go
    when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], rows: int, width: int = 64, how: str = "inner") -> DataFrame:
    """Join that broadcasts ``small`` only when its counted rows times ``width`` stay under BROADCAST_BYTES.

    Beyond that both sides are shuffled and adaptive execution splits a hot key.
    """
    return big.join(F.broadcast(small) if rows * width <= BROADCAST_BYTES else small, list(on), how)


def salt_of(*cols: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def gapless_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, salts: int = 256) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... without ever sorting a whole key in one task.

    Rows are spread over ``salts`` sub-groups by the hash of their ``order`` columns.  The counts
    of the sub-groups give each one its first number, a window inside it gives the rest.  Rows
    that agree in all ``order`` columns are interchangeable.
    """
    salted = df.withColumn("__salt", salt_of(*[F.col(c) for c in order], salts=salts))
    counts = salted.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*keys, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy(*keys, "__salt").orderBy(*order)
    ranked = salted.withColumn("__rn", F.row_number().over(within))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "__salt"]]
    joined = ranked.alias("a").join(first.alias("b"), same)
    kept = [F.col(f"a.{c}") for c in df.columns if c != name]
    return joined.select(*kept, (F.col("__first") + F.col("__rn") - 1).cast("long").alias(name))


def byte_column(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("string")


def byte_slices(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string or binary column: first row, end row, their bytes, offsets into those.

    A run holds at most ``limit`` bytes, or one row.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def grouped_batches(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of rows with one value of ``key`` from batches that are sorted by it."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = np.asarray(table.column(key).to_numpy())
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if held and held_key != keys[lo]:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(lo, hi - lo))
            held_key = keys[lo]
    if held:
        yield pa.concat_tables(held)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, as a row may be a long text, unless the session says how many."""
    for name, value in BATCH_LIMITS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two multiply-xor-shift rounds)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial base modulo 2**64, and of its inverse."""
    size = 1 << max(20, int(n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for base in (_BASE, inverse):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(p, out=p)
            both.append(p)
        _powers[size] = (both[0], both[1])
    forward, backward = _powers[size]
    return forward, backward


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of bytes modulo 2**64; with ``powers`` they give the hash of any substring."""
    forward, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    values = out[1:]
    values[:] = data
    with np.errstate(over="ignore"):
        values += np.uint64(1)
        values *= forward[: len(data)]
        np.cumsum(values, out=values)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end); equal bytes have equal hashes wherever they stand."""
    _, backward = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[start]) * backward[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def ordered_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given order: range partitions, their counts, then a window in each."""
    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    firsts, total = [], 0
    for part, n in counts:  # as many entries as there are shuffle partitions
        firsts += [F.lit(part), F.lit(total)]
        total += n
    first = F.create_map(*firsts)[F.col("__part")] if firsts else F.lit(0)
    within = Window.partitionBy("__part").orderBy(*order)
    return ranged.withColumn(name, (first + F.row_number().over(within) - 1).cast("long")).drop("__part")


def units(separator: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the runs of bytes that are no separators; a run ends where its text does."""
    edges = np.diff(np.concatenate([[1], separator.astype(np.int8), [1]]))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < len(separator))]
    cut = cut[~separator[cut] & ~separator[cut - 1]]
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
