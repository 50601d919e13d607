"""Shared plumbing: tables, folds, durable intermediate results, Arrow streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import settle, shared_folder, ship  # noqa: F401

ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Ready for Python workers: they have this package, and long texts go to them in batches of
    bounded rows (the default of 10,000 rows is for numbers)."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(key).cast("string")) % F.lit(modulus)


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """True for rows whose labels must not be learned; a row without an id is one of them."""
    return F.coalesce(fold(modulus, key) == F.lit(remainder), F.lit(True))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to meet no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x worked out once, however often it stands in it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


MARKS = 1 << 20  # bits of a set of marks


def marks(keys: DataFrame, *columns: str) -> bytes:
    """A bit for the hash of each row's columns. The set has MARKS bits, whatever the number of rows."""
    at = F.pmod(F.xxhash64(*columns), F.lit(MARKS))
    bits = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 8).cast("int").alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("at", F.lit(8)).cast("int"))).alias("bits"))
    out = bytearray(MARKS // 8)
    for r in bits.collect():
        out[r.byte] = r.bits
    return bytes(out)


def marked(bits: bytes, *columns: Column) -> Column:
    """False only for rows that are not in the set; of others some are true by chance, more of them as the set fills."""
    at = F.pmod(F.xxhash64(*columns), F.lit(MARKS))
    byte = F.conv(F.hex(F.substring(F.lit(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def about(df: DataFrame, n: int, *key: str) -> DataFrame:
    """All rows if there are at most n, else a hash-chosen share of n rows expected.

    For fitting only: the choice depends on the key columns alone, needs no shuffle and
    repeats identically when a task is retried.
    """
    total = df.count()
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("about"), *key), F.lit(1 << 40)) < F.lit(int(n / total * (1 << 40))))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables that never split a key, from batches sorted by key; the last key waits for its rest."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        block = pa.Table.from_batches(held)
        keys = block.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if cut:
            yield block.slice(0, cut)
        held = block.slice(cut).combine_chunks().to_batches()
        count = block.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def summed(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], width: int, slots: int = 8) -> np.ndarray:
    """The sum over all partitions of a vector of fixed width that `part` makes of each.

    Partitions meet in `slots` groups on executors, so the driver gets `slots` vectors
    whatever the number of partitions.
    """

    def each(batches):
        from pyspark import TaskContext

        vector = np.asarray(part(batches), dtype="f8")
        yield pa.RecordBatch.from_pydict({"slot": [TaskContext.get().partitionId() % slots], "v": [vector]}, schema=shape)

    def meet(tables: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for v in tables.column("v"):
            total += v.values.to_numpy(zero_copy_only=False)
        return pa.table({"v": pa.array([total], pa.list_(pa.float64()))})

    shape = pa.schema([("slot", pa.int32()), ("v", pa.list_(pa.float64()))])
    rows = df.mapInArrow(each, "slot int, v array<double>").groupBy("slot").applyInArrow(meet, "v array<double>").toArrow()
    out = np.zeros(width)
    for v in rows.column("v"):
        out += v.values.to_numpy(zero_copy_only=False)
    return out


def matrix(column: pa.ChunkedArray | pa.Array, width: int, dtype: str = "f4") -> np.ndarray:
    """Rows of a list column of one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)
