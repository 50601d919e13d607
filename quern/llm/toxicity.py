"""Toxicity classifier with a counterfactual penalty on identity terms."""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import settle, small_batches

# Terms that name groups of people; each row holds terms that may stand for each other.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys", "transgender", "nonbinary"],
    ["woman", "man", "girl", "boy"],
    ["gay", "lesbian", "straight", "bisexual", "queer"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"],
    ["black", "white", "asian", "latino", "arab", "african", "european"],
    ["immigrants", "refugees", "foreigners", "natives", "citizens"],
    ["disabled", "blind", "deaf", "autistic", "elderly", "young"],
    ["frauen", "männer", "muslime", "christen", "juden", "ausländer"],
    ["femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers"],
    ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros"],
]
SWAPS = {t: [x for x in row if x != t] for row in IDENTITY_TERMS for t in row}
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
BUCKETS = 1 << 20
STEMS = (3, 4, 5, 6)
CACHED_WORDS = 400_000
TERMS = 150  # neutral terms taken from the corpus, at most
PARTNERS = 2  # terms that may stand for each of them
PAIRS = 24  # counterfactual sentences of one text to learn from, at most


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    raw = ["=" + word, *("^" + word[:k] for k in STEMS if len(word) >= k)]
    return tuple(zlib.crc32(x.encode()) % BUCKETS for x in raw)


def features(text: str | None) -> set[int]:
    out: set[int] = set()
    for w in set(WORD.findall(text.lower())) if text else ():
        out.update(word_features(w))
    return out


def counterfactuals(text: str | None, swaps: dict[str, list[str]] = SWAPS, most: int = PAIRS) -> list[tuple[set[int], set[int]]]:
    """(features only of the sentence, features only of it with swapped terms) of at most `most` pairs of sentences.

    Each sentence that holds terms is taken with every term that may stand for its own; sentences
    with listed identity terms come first, others in the order of their hashes.
    """
    out: list[tuple[set[int], set[int]]] = []
    found = []
    for sentence in SENTENCE.split(text.lower()) if text else ():
        words = WORD.findall(sentence)
        if not swaps.keys().isdisjoint(words):
            found.append((SWAPS.keys().isdisjoint(words), zlib.crc32(sentence.encode()), words))
    for _, _, words in sorted(found):
        old = set().union(*map(word_features, words))
        for k in range(max(len(swaps[w]) for w in words if w in swaps)):
            if len(out) >= most:
                return out
            new = set().union(*(word_features(swaps[w][k % len(swaps[w])] if w in swaps else w) for w in words))
            if new != old:
                out.append((old - new, new - old))
    return out


def neutral_terms(sample: DataFrame, seen: dict[int, int], most: int = TERMS) -> dict[str, list[str]]:
    """Words of the corpus that name no more than a listed term does, each with those that may stand for it.

    sample: (y, text); seen: its rows of either label. A term is a word of three letters or more in
    one text of 200 to three of ten, as often in texts of either label as chance allows: a score has
    no reason to change with it. Of the most frequent `most` of them, terms that stand in the same
    texts (by cosine of their presence) may stand for each other, so a swap keeps to the language.
    """
    n = {y: float(seen[y]) for y in (0, 1)}

    def each(batches):
        for b in batches:
            own = [sorted(set(WORD.findall(t.lower()))) if t else [] for t in b.column("text").to_pylist()]
            y = np.repeat(b.column("y").to_numpy(), [len(w) for w in own])
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array([x for w in own for x in w], pa.string())], names=["y", "word"])

    count = sample.mapInArrow(each, "y int, word string").where(F.length("word") >= 3).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
    every = n[0] + n[1]
    share = F.col("n") / every
    gap = F.abs(F.col("n1") / n[1] - (F.col("n") - F.col("n1")) / n[0])
    chance = F.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
    kept = count.where((F.col("n") >= max(5.0, every / 200)) & (share <= 0.3) & (gap <= 2 * chance))
    words = [r.word for r in kept.orderBy(F.desc("n"), "word").limit(most).collect()]
    words = [w for w in words if w not in SWAPS]
    if len(words) < 2:
        return {}
    number = {w: i for i, w in enumerate(words)}

    def present(batches):
        for b in batches:
            own = [sorted({number[w] for w in WORD.findall(t.lower()) if w in number}) if t else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32()))], names=["terms"])

    lists = sample.mapInArrow(present, "terms array<int>").toArrow().column(0).to_pylist()  # rows of the sample, `most` numbers each
    x = np.zeros((len(lists), len(words)), dtype="f4")
    for i, own in enumerate(lists):
        x[i, own] = 1
    together = x.T @ x
    size = np.sqrt(np.maximum(np.diag(together), 1))
    like = together / size[:, None] / size
    np.fill_diagonal(like, -1)
    best = np.argsort(-like, axis=1, kind="stable")[:, :PARTNERS]
    return {w: [words[j] for j in best[i] if j != i] for i, w in enumerate(words)}


class Model:
    """Logistic score over the presence of chosen features in a whole text."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        kept = weights != 0
        self.weight = dict(zip(chosen[kept].tolist(), weights[kept].tolist()))
        self.bias = float(bias)
        self.pairs = 0  # counterfactual sentences learned from, whose features the model can weigh
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        known = self.known
        for w in set(WORD.findall(text.lower())) if text else ():
            f = known.get(w)
            if f is None:
                if len(known) >= CACHED_WORDS:
                    known.clear()
                f = known[w] = tuple(x for x in word_features(w) if x in self.weight)
            if f:
                found.update(f)
        z = self.bias + sum(self.weight[x] for x in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled ids of either label, those first by hash. An id labelled twice is toxic if once."""
    once = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    pick = [once.where(F.col("y") == y).orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(most) for y in (0, 1)]
    return pick[0].unionByName(pick[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = 5000, keep: int = 4000, fairness: float = 4.0, sparsity: float = 2e-3, rounds: int = 300) -> Model:
    """Learn from at most `most` labelled rows of each label (the documented bound of the sample).

    Features that occur in five sampled texts or more are ranked by how their share differs
    between the labels and the first `keep` are chosen, and those of the terms that are swapped.
    Weights minimise the logistic loss, an absolute penalty and `fairness` times the mean squared
    change of score over the counterfactual sentences, PAIRS of a text at most, by accelerated
    proximal steps. Swapped are the listed identity terms and the corpus's own neutral terms. An id
    with several rows counts once, with its least text. The driver gets at most 2 * `most` rows of
    feature numbers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    prior = labels.where("toxic is not null").agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if prior is None:
        return Model(np.zeros(0, dtype=int), np.zeros(0), 0.0)
    ids = _sample(labels, most).toArrow()  # 2 * most ids at most
    small = F.broadcast(spark.createDataFrame(ids.to_pandas(), "doc_id long, y int"))

    texts_ = settle(docs.select("doc_id", "text").join(small, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text"))
    seen = {r.y: r.n for r in texts_.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        p = np.clip(prior, 1e-3, 1 - 1e-3)
        return Model(np.zeros(0, dtype=int), np.zeros(0), np.log(p / (1 - p)))
    swaps_of = neutral_terms(texts_, seen) | SWAPS

    def each(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            swaps = [counterfactuals(t, swaps_of) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("y"),
                    pa.array([sorted(features(t)) for t in texts], pa.list_(pa.int32())),
                    pa.array([[sorted(a) for a, _ in s] for s in swaps], pa.list_(pa.list_(pa.int32()))),
                    pa.array([[sorted(c) for _, c in s] for s in swaps], pa.list_(pa.list_(pa.int32()))),
                ],
                names=["y", "f", "lost", "won"],
            )

    rows = settle(texts_.mapInArrow(each, "y int, f array<int>, lost array<array<int>>, won array<array<int>>"))
    share = {y: F.sum((F.col("y") == y).cast("int")) / F.lit(float(seen[y])) for y in (0, 1)}
    ranked = (
        rows.select("y", F.explode("f").alias("k"))
        .groupBy("k")
        .agg(F.count(F.lit(1)).alias("n"), share[0].alias("p0"), share[1].alias("p1"))
        .where("n >= 5")
        .withColumn("gap", F.pow(F.col("p1") - F.col("p0"), 2) / (F.col("p1") + F.col("p0")))
        .orderBy(F.desc("gap"), "k")
        .limit(keep)
    )
    of_terms = np.array(sorted({f for w, others in swaps_of.items() for x in (w, *others) for f in word_features(x)}), dtype="i4")
    chosen = np.union1d(ranked.select("k").toArrow().column(0).to_numpy(), of_terms)

    def only(batches):
        for b in batches:
            def cut(lists):
                return [np.flatnonzero(np.isin(chosen, np.asarray(x, dtype="i4"))).astype("i4") for x in lists]

            yield pa.RecordBatch.from_arrays(
                [
                    b.column("y"),
                    pa.array(cut(b.column("f").to_pylist()), pa.list_(pa.int32())),
                    pa.array([cut(x) for x in b.column("lost").to_pylist()], pa.list_(pa.list_(pa.int32()))),
                    pa.array([cut(x) for x in b.column("won").to_pylist()], pa.list_(pa.list_(pa.int32()))),
                ],
                names=["y", "f", "lost", "won"],
            )

    local = rows.mapInArrow(only, "y int, f array<int>, lost array<array<int>>, won array<array<int>>").toArrow()
    y = local.column("y").to_numpy().astype("f8")

    def sparse(lists):
        at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return at, np.concatenate([np.asarray(x, dtype=np.int64) for x in lists] or [np.zeros(0, dtype=np.int64)])

    lists = local.column("f").to_pylist()
    row, col = sparse(lists)
    swaps = [(a, b) for la, lb in zip(local.column("lost").to_pylist(), local.column("won").to_pylist()) for a, b in zip(la, lb) if a or b]
    lost, won = sparse([a for a, _ in swaps]), sparse([b for _, b in swaps])
    n, d, m = len(y), len(chosen), max(1, len(swaps))
    # both labels weigh as they occur among all labels
    weight = np.where(y == 1, prior / seen[1], (1 - prior) / seen[0])
    weight /= weight.sum()

    def slope(w, bias):
        z = np.bincount(row, w[col], n) + bias
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(col, e[row], d)
        if swaps:
            delta = np.bincount(won[0], w[won[1]], m) - np.bincount(lost[0], w[lost[1]], m)
            g += 2 * fairness / m * (np.bincount(won[1], delta[won[0]], d) - np.bincount(lost[1], delta[lost[0]], d))
        return g, e.sum()

    # per-coordinate steps from a bound on the curvature
    size = np.bincount(row, minlength=n) + 1.0
    curve = 0.25 * np.bincount(col, (weight * size)[row], d) + 1e-6
    if swaps:
        long_ = np.bincount(won[0], minlength=m) + np.bincount(lost[0], minlength=m)
        curve += 2 * fairness / m * (np.bincount(won[1], long_[won[0]], d) + np.bincount(lost[1], long_[lost[0]], d))
    step, step0 = 1 / curve, 1 / (0.25 * (weight * size).sum())
    w, bias = np.zeros(d), float(np.log(prior / (1 - prior)))
    v, vb, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        g, g0 = slope(v, vb)
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * sparsity * np.sqrt(curve / curve.max()), 0)
        newb = vb - step0 * g0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), newb + (t - 1) / t2 * (newb - bias)
        w, bias, t = new, newb, t2
    model = Model(chosen, w, bias)
    model.pairs = len(swaps)
    return model


def with_toxicity(docs: DataFrame, labels: DataFrame, learnable: Column, threshold: float = 0.5, **options) -> DataFrame:
    """docs with toxicity_score (0 to 1) and toxicity (1 if at or over the threshold) of every whole text.

    labels: (doc_id, toxic 0/1); `learnable` is a condition on doc_id. Null and empty texts get the
    score of a text without a known feature. Without a learnable label every score is 0.5 and
    nothing is toxic. Repeated rows are scored each. Scores see the text alone; other columns pass
    through on the JVM side, whatever their names, except those two, which are replaced.
    """
    model = fit(docs.select("doc_id", "text"), labels.where(learnable), **options)
    blank = not model.weight and not model.bias

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    scored = docs.withColumn("toxicity_score", score("text"))
    return scored.withColumn("toxicity", F.lit(0) if blank else (F.col("toxicity_score") >= threshold).cast("int"))
