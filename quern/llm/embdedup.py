"""Embedding near-dedup by a subspace pigeonhole join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import about, matrix, settle, small_batches
from quern.llm.components import components
from quern.llm.vectors import valid_vectors

SAMPLE = 16_000  # rows that the rotation is fitted on, at most about
UNIT = 1 << 15  # components of unit vectors are kept as whole numbers of this part
LARGE = 16_000  # rows of a cell that one task compares
ROWS = 512


class Blocks:
    """Rotation in whole numbers and the blocks of its axes with their budgets.

    All coordinates are whole numbers below 2**53 made by exact sums, so every task, on whatever
    machine, finds the same value and a pair belongs to the same block everywhere.
    """

    def __init__(self, sample: np.ndarray, cosine: float, blocks: int):
        d = sample.shape[1]
        unit = directions(sample)
        energy, axes = np.linalg.eigh(unit.T @ unit / len(unit))
        order = np.argsort(-energy)
        self.rotation = np.round(axes[:, order] * UNIT)
        count = max(1, min(blocks, d))
        edges = [round(i * d / count) for i in range(count + 1)]
        self.parts = [slice(a, b) for a, b in zip(edges, edges[1:])]
        share = np.array([max(energy[order][p].sum(), 0) for p in self.parts])
        share = np.maximum(share, 0.02 * share.sum() / count)
        # squared distance of unit vectors at the cosine, dealt to blocks in proportion to their energy;
        # rounding to whole numbers moves a vector by less than d / UNIT
        self.total = (np.sqrt(2 - 2 * cosine) + 4 * d / UNIT) ** 2
        self.budget = np.ceil(self.total * share / share.sum() * self.scale**2)
        self.width = np.ceil(np.sqrt(self.budget)) + 1

    scale = float(UNIT * UNIT >> 8)

    def rotated(self, q: np.ndarray) -> np.ndarray:
        """Exact coordinates of quantised unit vectors."""
        return np.floor((q.astype("f8") @ self.rotation) / 256)

    def cells(self, z: np.ndarray, block: int) -> np.ndarray:
        """Number of the interval, as wide as the block's budget reaches, on the block's first axis."""
        return np.floor(z[:, self.parts[block].start] / self.width[block]).astype(np.int64)


def directions(v: np.ndarray) -> np.ndarray:
    """Unit vectors. Scaled by the largest component first, no square over- or underflows; summed axis by
    axis, every machine finds the same."""
    v = v / np.abs(v).max(axis=1, initial=0, keepdims=True)
    total = np.zeros(len(v))
    for axis in v.T:
        total += axis * axis
    return v / np.sqrt(total)[:, None]


def quantised(v: np.ndarray) -> np.ndarray:
    return np.round(directions(v) * UNIT).astype(np.int32)


def compare(rows: dict[str, np.ndarray], z: np.ndarray, side: np.ndarray, block: int, plan: Blocks, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, weighted by copies; label of its local component) among the pairs that
    belong to this block: within its budget, and within no earlier block's.

    Rows are in order of the block's first axis, so those within reach of some are a slice; side 0
    comes before side 1, whose rows are not compared among themselves. Squared distances of a slice
    are one product in single precision against a slightly larger budget; what remains is checked
    exactly, and then by the cosine in double precision.
    """
    v, weight, same = rows["v"], rows["w"], rows["part"]
    own = z[:, plan.parts[block]]
    unit = directions(v)
    n = len(v)
    links, label = np.zeros(n), np.arange(n)
    small = own / plan.scale
    norm = (small**2).sum(1, keepdims=True)
    left = np.hstack([small, norm, np.ones((n, 1))]).astype("f4")
    right = np.ascontiguousarray(np.hstack([-2 * small, np.ones((n, 1)), norm]).astype("f4").T)
    limit = np.float32(plan.budget[block] / plan.scale**2 * (1 + 1e-4) + 1e-5)
    homes = int((side == 0).sum())
    for at in range(0, homes, ROWS):
        end = min(at + ROWS, homes)
        stop = int(np.searchsorted(own[:, 0], own[end - 1, 0] + plan.width[block], "right"))
        hit = np.flatnonzero(left[at:end] @ right[:, at:stop] <= limit)
        a, b = hit // (stop - at) + at, hit % (stop - at) + at
        keep = b > a  # each pair once
        if rows["cross"]:  # the two parts of a split cell meet here only crosswise
            keep &= same[a] != same[b]
        a, b = a[keep], b[keep]
        for lo in range(0, len(a), 100_000):
            x, y = a[lo : lo + 100_000], b[lo : lo + 100_000]
            true = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
            x, y = x[true], y[true]
            mine = ((own[x] - own[y]) ** 2).sum(1) <= plan.budget[block]
            for earlier in range(block):
                e = plan.parts[earlier]
                mine &= ((z[x, e] - z[y, e]) ** 2).sum(1) > plan.budget[earlier]
            x, y = x[mine], y[mine]
            links += np.bincount(x, weight[y], n) + np.bincount(y, weight[x], n)
            while len(x):
                lx, ly = label[x], label[y]
                apart = lx != ly
                if not apart.any():
                    break
                np.minimum.at(label, np.maximum(lx, ly)[apart], np.minimum(lx, ly)[apart])
                while (label[label] != label).any():
                    label = label[label]
    return links.astype(np.int64), label


def linked_vectors(table: DataFrame, cosine: float = 0.9, blocks: int = 4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of table (vec_id, embedding).

    Rows link if the cosine of their vectors, in double precision, is at least `cosine`. Unit
    vectors that near are within a squared distance; rotated to principal axes and split into
    blocks of few dimensions, one block must be within its share of that budget. Each block is
    range-joined on its first axis (cells as wide as the share reaches; a row visits its own cell
    and the one below), and candidates are verified exactly. Equal vectors are one row with a
    weight in all this. Tasks give sums of links and stars of local components, never pairs.

    Rows left out by ``valid_vectors`` have no links and are their own component; a null vec_id
    gives nulls there. Rows repeated with equal id and vector count as copies that link. Cells of
    more than LARGE rows are split, and all pairs of splits compared.
    """
    spark = table.sparkSession
    small_batches(spark)
    ids = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows, d = valid_vectors(table)
    alone = ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not d:
        return alone
    hashes = [F.xxhash64("v"), F.xxhash64(F.lit(1), "v")]
    rows = rows.select("vec_id", "v", hashes[0].alias("h1"), hashes[1].alias("h2"))
    single = rows.groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("w"), F.min("h1").alias("h1"), F.min("h2").alias("h2"))

    single = settle(single.select("node", "v", "w", "h1", "h2"))
    plan = Blocks(matrix(about(single, SAMPLE, "node").select("v").toArrow().column(0), d, "f8"), cosine, blocks)

    kind = dict(rows.dtypes)["v"]

    def cells(v: pa.Array) -> pa.Array:
        z = plan.rotated(quantised(matrix(v, d, "f8")))
        return pa.array(list(np.stack([plan.cells(z, k) for k in range(len(plan.parts))], axis=1)), pa.list_(pa.int64()))

    def count(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([cells(b.column("v"))], names=["cells"])

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, cells(b.column("v"))], names=[*b.schema.names, "cells"])

    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("c").alias("cell")), F.struct(F.lit(1).alias("side"), (F.col("c") - 1).alias("cell")))).alias("x")
    counted = single.select("v").mapInArrow(count, "cells array<long>").select(F.posexplode("cells").alias("block", "c")).select("block", both)
    sizes = counted.groupBy("block", "x.cell").agg(F.ceil(F.count(F.lit(1)) / LARGE).cast("int").alias("splits"))
    placed = single.select("node", "v", "w").mapInArrow(place, f"node long, v {kind}, w long, cells array<long>")
    visits = placed.select("node", "v", "w", F.posexplode("cells").alias("block", "c")).select("node", "v", "w", "block", both).select("node", "v", "w", "block", "x.*")
    split = visits.join(sizes, ["block", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), "splits").cast("int"))
    dealt = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    dealt = dealt.select("block", "cell", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("r"), "part", "side", "node", "v", "w")
    result = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def join(key, t):
        block, p, r = key[0].as_py(), key[2].as_py(), key[3].as_py()
        v = matrix(t.column("v"), d, "f8")
        z = plan.rotated(quantised(v))
        order = np.lexsort((t.column("node").to_numpy(), z[:, plan.parts[block].start]))
        z, node = z[order], t.column("node").to_numpy()[order]
        data = {"v": v[order], "w": t.column("w").to_numpy()[order].astype("f8"), "part": t.column("part").to_numpy()[order], "cross": p != r}
        links, label = compare(data, z, t.column("side").to_numpy()[order], block, plan, cosine)
        some = (links > 0) | (label != np.arange(len(node)))
        return pa.table([node[some], links[some], node[label[some]]], schema=result)

    found = settle(dealt.groupBy("block", "cell", "p", "r").applyInArrow(join, "node long, links long, root long"))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("component", "c")
    per = single.select("node", "w", "h1", "h2").join(degree, "node", "left").join(named, "node", "left")
    per = per.select("h1", "h2", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("c", "node").alias("component_id"))
    valid = rows.select("vec_id", "h1", "h2").join(per, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    out = valid.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    rest = _left_out(ids, d)
    return out.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))


def _left_out(ids: DataFrame, d: int) -> DataFrame:
    """Rows that ``valid_vectors`` leaves out, by the same conditions."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(F.coalesce(x, F.lit(0.0))) | (F.abs(F.coalesce(x, F.lit(0.0))) == float("inf")))
    zero = ~F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    return ids.where(F.col("embedding").isNull() | F.col("vec_id").isNull() | F.coalesce(odd, F.lit(True)) | zero | (F.size("embedding") != d))


ORACLE = """
WITH RECURSIVE good AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM good UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(l.n, 0) AS n_links, coalesce(m.c, v.vec_id) AS component_id, coalesce(m.c, v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN links l ON l.a = v.vec_id LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = v.vec_id
"""
