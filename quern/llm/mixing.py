"""Mixing sources to target weights by Poisson replication. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import let, unused

PART = 256.0  # a larger mean is drawn as the sum of several Poisson numbers, so exp(-mean) never underflows
BROADCAST_SOURCES = 20_000
SALTS = 32


def unit(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float = 1.0) -> DataFrame:
    """(source, n, rate): the mean number of copies of each source's rows.

    Target weights are given by source (a source without one gets none) or else n ** temperature;
    rates make the expected mixture follow them and hold `budget` times as many rows as docs.
    Null is a source like any other.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature)) if temperature != 0.5 else F.sqrt(F.col("n").cast("double"))
    else:
        weight = F.lit(0.0)
        for source, w in sorted(weights.items(), key=lambda x: str(x[0])):
            if w < 0:
                raise ValueError("weights must not be negative")
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    rows, total = sizes.agg(F.sum("n"), F.sum("weight")).first()
    if rows and not total:
        raise ValueError("no source of the documents has a weight")
    scale = F.lit(float(rows or 0) * budget / (total or 1.0))
    return sizes.select("source", "n", (F.col("weight") * scale / F.col("n")).alias("rate"))


def _copies(parts: Column, mean: Column, cdf: Column, key: Column, seed: str) -> Column:
    """Sum over the parts of the least k whose distribution function exceeds the part's hash number."""
    each = F.transform(F.sequence(F.lit(1), parts), lambda j: let(unit(F.lit(seed), j.cast("string"), key), lambda u: F.size(F.filter(cdf, lambda c: c <= u))))
    return F.when(mean > 0, F.aggregate(each, F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))


def _distribution(mean: Column) -> Column:
    """Distribution function of the Poisson law at 0, 1, ... until it no longer grows."""
    most = (mean + F.lit(12.0) * F.sqrt(mean) + F.lit(30.0)).cast("int")
    first = F.exp(-mean)
    run = F.aggregate(
        F.sequence(F.lit(1), most),
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda a, k: F.struct((a["p"] * mean / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * mean / k)).alias("c")),
    )
    return run["c"]


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float = 1.0, seed: str = "mix") -> DataFrame:
    """docs with each row as many times as its Poisson number, in a globally shuffled order.

    Adds `replica` (1 to copies), `copies`, and `shuffle_key`, by whose hash rows are dealt to
    partitions and by which they are ordered there. The number depends on seed and doc_id
    alone: equal ids, repeated rows too, get equal numbers; null is an id of its own. Empty docs
    give an empty result; text is carried, never read. Columns of docs by those three names are
    replaced, others may have any names.
    """
    columns = [c for c in docs.columns if c not in ("replica", "copies", "shuffle_key")]
    null, name, key, rate, parts, cdf, salt = own = unused(docs, "null", "name", "key", "rate", "parts", "cdf", "salt")
    table = rates(docs, weights, temperature, budget).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int")))
    table = table.select(
        F.col("source").isNull().alias(null),
        F.coalesce("source", F.lit("")).alias(name),
        F.col("rate").alias(rate),
        F.col("parts").alias(parts),
        _distribution(F.col("rate") / F.col("parts")).alias(cdf),
    )
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(*columns, F.col("source").isNull().alias(null), F.coalesce("source", F.lit("")).alias(name), text_id.alias(key))
    if docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(table), [null, name])
    else:  # a source may hold a third of all rows, so each is dealt to several tasks
        salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn(salt, F.pmod(F.hash(key), F.lit(SALTS))).join(salted, [null, name, salt])
    counted = joined.withColumn("copies", _copies(F.col(parts), F.col(rate), F.col(cdf), F.col(key), seed)).where("copies > 0")
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed + "-order"), key, F.col("replica").cast("string"))), 1, 15), 16, 10).cast("long")
    copied = counted.select(*columns, "copies", key, F.explode(F.sequence(F.lit(1), "copies")).alias("replica")).withColumn("shuffle_key", order).drop(*own)
    return copied.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE = """
WITH sizes AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, weight * ((SELECT sum(n) FROM sizes)::DOUBLE / (SELECT sum(weight) FROM sizes)) / n AS rate FROM sizes),
steps AS (SELECT source, rate, unnest(range(0, (rate + 12 * sqrt(rate) + 30)::INT + 1)) AS k FROM rates),
mass AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1.0)) AS p FROM steps),
law AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM mass),
drawn AS (SELECT doc_id, source, ('0x' || substr(md5('mix:1:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, count(*) FILTER (WHERE l.c <= d.u) AS copies FROM drawn d JOIN law l ON l.source IS NOT DISTINCT FROM d.source GROUP BY ALL)
SELECT doc_id, source, copies::INT AS copies, r::INT AS replica,
       ('0x' || substr(md5('mix-order:' || doc_id || ':' || r), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS r FROM counted)
"""
