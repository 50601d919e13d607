"""What the two vector operators share: checked vectors of one length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(table: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their length.

    Null, empty and zero vectors and those with null or non-finite components take no part; nor do
    vectors of another length than most valid ones have (of lengths equally frequent the largest).
    """
    v = F.col("embedding").cast("array<double>")
    good = F.aggregate(
        v, F.struct(F.lit(True).alias("ok"), F.lit(0.0).alias("s")), lambda a, x: F.struct((a["ok"] & x.isNotNull() & (F.abs(F.coalesce(x, F.lit(0.0))) < float("inf")) & ~F.isnan(F.coalesce(x, F.lit(0.0)))).alias("ok"), F.greatest(a["s"], F.abs(F.coalesce(x, F.lit(0.0)))).alias("s"))
    )
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), good.alias("g")).where("v is not null and g.ok and g.s > 0 and vec_id is not null")
    rows = rows.select("vec_id", "v")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return rows.limit(0), 0
    return rows.where(F.size("v") == lengths[0].d), lengths[0].d
