"""Nearest neighbours by an inverted-list index with adaptive dimension scans."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import about, matrix, settle, small_batches
from quern.llm.vectors import valid_vectors

SAMPLE = 16_000  # rows that the index is fitted on, at most about
BLOCK = 8  # dimensions in one step of a scan
CHUNK = 20_000  # candidates of a list in one task
QUERIES = 2_000  # queries of a list in one task
DOUBT = 2.1  # a candidate is abandoned if chance would leave its partial distance so far out


@dataclass
class Index:
    """Rotation, list centres (in rotated space) and the share of lists to probe."""

    rotation: np.ndarray
    centres: np.ndarray
    probes: int

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each rotated vector, nearest first."""
        d = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        near = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1), 1)


def fit(sample: np.ndarray, rows: int, k: int, target: float, seed: int = 5) -> Index:
    """Random rotation, k-means lists (about the root of the number of rows, 1024 at most) and the
    probes that reach `target` recall for 256 rows of the sample against all of the sample, plus two."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    x = sample @ rotation
    lists = int(min(1024, max(1, np.sqrt(rows)), max(1, len(x) // 8)))
    centres = x[rng.choice(len(x), lists, replace=False)]
    index = Index(rotation, centres, lists)
    for _ in range(8):
        at = np.concatenate([index.lists(x[i : i + 4096], 1)[:, 0] for i in range(0, len(x), 4096)])
        n = np.bincount(at, minlength=lists)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        index.centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], index.centres)
    if lists == 1:
        return index
    at = np.concatenate([index.lists(x[i : i + 4096], 1)[:, 0] for i in range(0, len(x), 4096)])
    some = rng.choice(len(x), min(256, len(x)), replace=False)
    gap = (x**2).sum(1) - 2 * x[some] @ x.T
    gap[np.arange(len(some)), some] = np.inf
    near = np.argpartition(gap, min(k, len(x) - 1) - 1, axis=1)[:, :k]
    place = np.argsort(index.lists(x[some], lists), axis=1)
    needed = np.take_along_axis(place, at[near], 1).ravel() + 1
    index.probes = int(min(lists, np.quantile(needed, target, method="higher") + 2))
    return index


def known_bound(x: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """The squared distance of each query's k-th nearest row of the sample but its own: no nearer neighbour is beyond it."""
    out = np.full(len(x), np.inf)
    if len(sample) <= k:
        return out
    norm = (sample**2).sum(1)
    for at in range(0, len(x), 128):
        q = x[at : at + 128]
        gap = norm + (q**2).sum(1)[:, None] - 2 * q @ sample.T
        gap[ids[at : at + 128, None] == sample_ids] = np.inf
        out[at : at + 128] = np.partition(gap, k - 1, axis=1)[:, k - 1]
    return out


def scan(queries: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, rows: np.ndarray, r_ids: np.ndarray, k: int) -> list[tuple[int, np.ndarray]]:
    """For each query the rows (positions) that may be among its k nearest.

    Both sides are rotated, so any leading dimensions are a fair sample of all. After each block of
    columns the hypothesis that a row is as near as the k-th best known is tested on its partial
    distance; rows that fail it are abandoned. `bound` is what the query knows from before this list;
    the k rows nearest here by the first block may lower it, and always stay.
    """
    d = queries.shape[1]
    step = min(BLOCK, d)
    head = rows[:, :step]
    partial = (queries[:, :step] ** 2).sum(1)[:, None] + (head**2).sum(1) - 2 * queries[:, :step] @ head.T
    partial[q_ids[:, None] == r_ids] = np.inf
    out = []
    for i, q in enumerate(queries):
        p = partial[i]
        left, seen = np.flatnonzero(np.isfinite(p)), step
        found = left[np.argpartition(p[left], k - 1)[:k]] if len(left) > k else left
        limit = min(bound[i], ((rows[found] - q) ** 2).sum(1).max()) if len(found) == k else bound[i]
        value = p[left]
        while len(left):
            near = value <= limit * seen / d * (1 + DOUBT / np.sqrt(seen)) ** 2 if seen < d else value <= limit * (1 + 1e-6)
            left, value = left[near], value[near]
            if seen >= d or not len(left):
                break
            nxt = min(d, seen + 2 * step)
            value = value + ((rows[left, seen:nxt] - q[seen:nxt]) ** 2).sum(1)
            seen = nxt
        out.append((i, np.union1d(found, left)))
    return out


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, target: float = 0.99) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by Euclidean distance.

    table: (vec_id, embedding); queries: some of its vec_ids (column vec_id). Rows that
    ``valid_vectors`` leaves out take no part on either side; a query's own row (all rows of its id)
    is no candidate; repeated other rows are candidates each. score is the exact distance of the
    original vectors in double precision; ties go to the smaller vec_id. A query gets all
    candidates if they are fewer than k. An id asked for more than once, or by several rows, is
    one query: of its vectors the least, as arrays are ordered. Every valid row is indexed; only
    the centres, the number of probes and each query's first bound come from a sample of about SAMPLE
    rows. Long lists are scanned in chunks of CHUNK rows and QUERIES queries, so that no task grows with a list.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows, d = valid_vectors(table)
    shape = "query_id long, rank int, vec_id long, score double"
    if not d:
        return spark.createDataFrame([], shape)
    total = rows.count()
    drawn = about(rows, SAMPLE, "vec_id").toArrow()
    sample, sample_ids = matrix(drawn.column("v"), d, "f8"), drawn.column("vec_id").to_numpy()
    index = fit(sample, total, k, target)
    turned = sample @ index.rotation
    lists = len(index.centres)

    def place(batches):
        for b in batches:
            x = matrix(b.column("v"), d, "f8") @ index.rotation
            at = index.lists(x, 1)[:, 0] if len(x) else np.zeros(0, dtype=int)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(at, pa.int32())], names=["vec_id", "v", "list"])

    kind = dict(rows.dtypes)["v"]
    placed = settle(rows.mapInArrow(place, f"vec_id long, v {kind}, list int"))
    size = {r.list: r.n for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([size.get(i, 0) for i in range(lists)])

    def probe(batches):
        for b in batches:
            x = matrix(b.column("v"), d, "f8") @ index.rotation
            if not len(x):
                continue
            order = index.lists(x, lists)
            # at least the fitted probes, and more until the lists hold enough rows
            enough = (np.cumsum(sizes[order], axis=1) <= 4 * k).sum(1) + 1
            n = np.minimum(lists, np.maximum(index.probes, enough))
            picked = [pa.array(o[:m], pa.int32()) for o, m in zip(order, n)]
            bound = known_bound(x, b.column("vec_id").to_numpy(), turned, sample_ids, k) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(bound), pa.array([p.to_pylist() for p in picked], pa.list_(pa.int32()))], names=["vec_id", "v", "bound", "lists"])

    asked = rows.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct(), "vec_id", "left_semi")
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    probing = settle(asked.mapInArrow(probe, f"vec_id long, v {kind}, bound double, lists array<int>").select("vec_id", "v", "bound", F.explode("lists").alias("list")))
    load = {r.list: r.n for r in probing.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = F.create_map(*[F.lit(x) for i in range(lists) for x in (i, -(-int(sizes[i] or 1) // CHUNK))])
    teams = F.create_map(*[F.lit(x) for i in range(lists) for x in (i, -(-load.get(i, 1) // QUERIES))])
    left = placed.select("list", F.pmod(F.xxhash64("vec_id"), chunks[F.col("list")]).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), teams[F.col("list")] - 1)).alias("team"), "vec_id", "v")
    right = probing.select("list", F.explode(F.sequence(F.lit(0), chunks[F.col("list")] - 1)).alias("part"), F.pmod(F.xxhash64("vec_id"), teams[F.col("list")]).cast("int").alias("team"), "vec_id", "v", "bound")
    answer = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not ours.num_rows or not theirs.num_rows:
            return answer.empty_table()
        x, y = matrix(ours.column("v"), d, "f8"), matrix(theirs.column("v"), d, "f8")
        xi, yi = ours.column("vec_id").to_numpy(), theirs.column("vec_id").to_numpy()
        xr, yr, bound = x @ index.rotation, y @ index.rotation, theirs.column("bound").to_numpy()
        q_out, v_out, s_out = [], [], []
        width = max(1, 4_000_000 // len(x))
        for at in range(0, len(y), width):
            for i, found in scan(yr[at : at + width], yi[at : at + width], bound[at : at + width], xr, xi, k):
                score = np.sqrt(((x[found] - y[at + i]) ** 2).sum(1))
                best = found[np.lexsort((xi[found], score))[:k]]
                s_out.append(np.sort(score)[:k])
                v_out.append(xi[best])
                q_out.append(np.full(len(best), yi[at + i]))
        return pa.table([np.concatenate(q_out), np.concatenate(v_out), np.concatenate(s_out)], schema=answer)

    keys = ["list", "part", "team"]
    near = right.groupBy(*keys).cogroup(left.groupBy(*keys)).applyInArrow(lambda q, c: meet(c, q), "query_id long, vec_id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
