"""Language ID: a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import small_batches

CORE, EDGE = 480, 16  # bytes of a span that are labelled, and that are read before and after them
AT_ONCE = 1024  # spans read together
LEARN = 64  # bytes of a span to learn from
LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])  # bytes of letters, and of all characters beyond ASCII
Arrays = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def start(hidden: int, languages: int, rng: np.random.Generator) -> Arrays:
    """Weights of both directions: input table (one row for each byte), recurrent, bias; and the output layer."""
    p: Arrays = {}
    for way in "fb":
        p["x" + way] = rng.normal(0, 0.3, (256, 3 * hidden)).astype("f4")
        p["u" + way] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype("f4")
        p["c" + way] = np.zeros(3 * hidden, dtype="f4")
        p["o" + way] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, languages)).astype("f4")
    p["co"] = np.zeros(languages, dtype="f4")
    return p


def states(p: Arrays, way: str, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states [T, N, H] over bytes [T, N] in reading order. keep: gets what the way back needs."""
    hidden = p["u" + way].shape[0]
    u = p["u" + way]
    uz, uc = np.ascontiguousarray(u[:, : 2 * hidden]), np.ascontiguousarray(u[:, 2 * hidden :])
    table = p["x" + way] + p["c" + way]
    h = np.zeros((steps.shape[1], hidden), dtype="f4")
    out = np.empty((len(steps), steps.shape[1], hidden), dtype="f4")
    for t, b in enumerate(steps):
        x = table[b]
        zr = sigmoid(x[:, : 2 * hidden] + h @ uz)
        z, r = zr[:, :hidden], zr[:, hidden:]
        rh = r * h
        c = np.tanh(x[:, 2 * hidden :] + rh @ uc)
        if keep is not None:
            keep.append((h, z, r, c, rh))
        h = h + z * (c - h)
        out[t] = h
    return out


def back(p: Arrays, way: str, steps: np.ndarray, kept: list, dout: np.ndarray, g: Arrays) -> None:
    """Backpropagation through time of one direction: adds to the slopes g."""
    hidden = p["u" + way].shape[0]
    u = p["u" + way]
    uz, uc = u[:, : 2 * hidden], u[:, 2 * hidden :]
    dh = np.zeros_like(dout[0])
    for t in range(len(steps) - 1, -1, -1):
        h, z, r, c, rh = kept[t]
        dh = dh + dout[t]
        dc = dh * z * (1 - c * c)
        drh = dc @ uc.T
        dz = dh * (c - h) * z * (1 - z)
        dr = drh * h * r * (1 - r)
        dzr = np.hstack([dz, dr])
        g["u" + way][:, : 2 * hidden] += h.T @ dzr
        g["u" + way][:, 2 * hidden :] += rh.T @ dc
        d = np.hstack([dzr, dc])
        np.add.at(g["x" + way], steps[t], d)
        g["c" + way] += d.sum(0)
        dh = dh * (1 - z) + drh * r + dzr @ uz.T


def read(p: Arrays, way: str, steps: np.ndarray) -> np.ndarray:
    """`states` without a way back. Signs and factors of the gates are put in the weights first."""
    hidden = p["u" + way].shape[0]
    gates = slice(0, 2 * hidden)
    table, u = -(p["x" + way] + p["c" + way]), -p["u" + way]
    tz, uz = np.ascontiguousarray(table[:, gates]), np.ascontiguousarray(u[:, gates])
    tc, uc = np.ascontiguousarray(2 * table[:, 2 * hidden :]), np.ascontiguousarray(2 * u[:, 2 * hidden :])
    out = np.empty((len(steps), steps.shape[1], hidden), dtype="f4")
    h = np.zeros((steps.shape[1], hidden), dtype="f4")
    for t, b in enumerate(steps):
        zr = np.dot(h, uz)
        zr += tz[b]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        c = np.dot(zr[:, hidden:] * h, uc)
        c += tc[b]
        np.exp(c, out=c)
        c += 1
        np.divide(2, c, out=c)
        c -= 1
        c -= h
        c *= zr[:, :hidden]
        h = np.add(h, c, out=out[t])
    return out


def probabilities(p: Arrays, steps: np.ndarray, rows: slice = slice(None)) -> np.ndarray:
    """Language probabilities [T, N, K] at the positions `rows` of bytes [T, N], all of which are read."""
    with np.errstate(over="ignore"):  # a gate that is shut
        logits = read(p, "f", steps)[rows] @ p["of"] + (read(p, "b", steps[::-1])[::-1][rows] @ p["ob"]) + p["co"]
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def slopes(p: Arrays, steps: np.ndarray, y: np.ndarray) -> tuple[float, Arrays]:
    """Mean cross-entropy over all positions of bytes [T, N] with languages y [N], and its slopes."""
    kf: list = []
    kb: list = []
    hf, hb = states(p, "f", steps, kf), states(p, "b", steps[::-1], kb)
    logits = hf @ p["of"] + hb[::-1] @ p["ob"] + p["co"]
    logits -= logits.max(-1, keepdims=True)
    e = np.exp(logits)
    q = e / e.sum(-1, keepdims=True)
    rows = np.arange(len(y))
    loss = -np.log(q[:, rows, y] + 1e-9).mean()
    d = q
    d[:, rows, y] -= 1
    d /= d.shape[0] * d.shape[1]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    flat = d.reshape(-1, d.shape[-1])
    g["of"] += hf.reshape(-1, hf.shape[-1]).T @ flat
    g["ob"] += hb[::-1].reshape(-1, hb.shape[-1]).T @ flat
    g["co"] += flat.sum(0)
    back(p, "f", steps, kf, d @ p["of"].T, g)
    back(p, "b", steps[::-1], kb, (d @ p["ob"].T)[::-1], g)
    return float(loss), g


def whole_characters(spans: np.ndarray) -> np.ndarray:
    """Spans [N, T] of UTF-8, with blanks for what is left of a character that an end cuts."""
    spans = spans.copy()
    rest = np.ones(len(spans), dtype=bool)
    for i in range(min(3, spans.shape[1])):
        rest &= (spans[:, i] & 0xC0) == 0x80
        spans[rest, i] = 32
    for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        if spans.shape[1] >= k:
            spans[spans[:, -k] >= least, -k:] = 32
    return spans


def cut(raw: bytes, core: int, edge: int) -> np.ndarray:
    """Spans [N, core + 2 * edge] whose middle parts make up the bytes in turn; blanks before and after them."""
    n = -(-len(raw) // core)
    padded = np.full(n * core + 2 * edge, 32, dtype=np.uint8)
    padded[edge : edge + len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, core + 2 * edge)[::core]


def train(spans: np.ndarray, y: np.ndarray, languages: int, hidden: int = 8, rounds: int = 600, batch: int = 128, seed: int = 11) -> Arrays:
    """Fit on spans [N, T] of bytes and their languages with Adam; batches draw languages alike."""
    rng = np.random.default_rng(seed)
    p = start(hidden, languages, rng)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    own = [np.flatnonzero(y == k) for k in range(languages)]
    own = [x for x in own if len(x)]
    for i in range(1, rounds + 1):
        pick = np.array([own[k][int(u * len(own[k]))] for k, u in zip(rng.integers(0, len(own), batch), rng.random(batch))])
        _, g = slopes(p, np.ascontiguousarray(spans[pick].T), y[pick])
        rate = 0.02 * (1 - i / (rounds + 1)) + 1e-4
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k in p:
            v = g[k] * min(1.0, 2.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * v
            s[k] = 0.99 * s[k] + 0.01 * v * v
            p[k] -= (rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-6)).astype("f4")
    return p


@dataclass
class Model:
    """Labels all positions of a text and pools them to one probability for each language.

    A text is read as its bytes, across words, in spans of CORE bytes with EDGE more on both sides,
    so that the states at the first and last labelled byte know what stands before and after.
    Positions of letters (and of other characters beyond ASCII) are pooled.
    """

    languages: list[str]
    weights: Arrays

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """[texts, K] mean probabilities over the positions; zeros for a text without a letter."""
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        waiting: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        middle = slice(EDGE, EDGE + CORE)

        def label() -> None:
            owner = np.concatenate(owners)
            steps = np.ascontiguousarray(whole_characters(np.concatenate(waiting)).T)
            letters = LETTER[steps[middle]].astype("f4")
            np.add.at(total, owner, np.einsum("tnk,tn->nk", probabilities(self.weights, steps, middle), letters))
            np.add.at(n, owner, letters.sum(0))
            waiting.clear()
            owners.clear()

        for i, t in enumerate(texts):
            if t and any(map(str.isalpha, t)):
                spans = cut(t.encode(), CORE, EDGE)
                for at in range(0, len(spans), AT_ONCE):
                    waiting.append(spans[at : at + AT_ONCE])
                    owners.append(np.full(len(waiting[-1]), i))
                    if sum(map(len, owners)) >= AT_ONCE:
                        label()
        if waiting:
            label()
        return total / np.maximum(n, 1)[:, None]

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        q = self.pooled(texts)
        best, score = q.argmax(1), q.max(1, initial=0.0)
        return [self.languages[b] if s > 0 else "und" for b, s in zip(best, score)], np.clip(score, 0, 1)


def fit(docs: DataFrame, learnable: Column, spans: int = 4000, **options) -> Model:
    """Learn from about `spans` spans of LEARN bytes of each language (the documented bound of the sample).

    They are drawn from all bytes of all learnable rows alike, by their ids. Languages are all non-null
    lang values of learnable rows (ties in order of their names).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text", "lang").where(learnable).where("lang is not null")
    pieces = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / LEARN)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum(pieces).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], {})
    share = {k: min(1.0, spans / max(1, counts[k])) for k in languages}

    def some(batches):
        for b in batches:
            found, langs = [], []
            for i, t, lang in zip(*(c.to_pylist() for c in b.columns)):
                own = cut((t or "").encode(), LEARN, 0)
                own = own[np.random.default_rng(i % (1 << 64)).random(len(own)) < share[lang]]
                found += [x.tobytes() for x in own]
                langs += [lang] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(langs, pa.string())], names=["span", "lang"])

    drawn = rows.where(F.length("text") > 0).select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(some, "span binary, lang string").toArrow()
    number = {k: i for i, k in enumerate(languages)}
    samples = sorted((x, number[k]) for x, k in zip(drawn.column(0).to_pylist(), drawn.column(1).to_pylist()))
    if not samples:
        return Model(languages[:1], start(1, 1, np.random.default_rng(0)))
    read_ = whole_characters(np.frombuffer(b"".join(x for x, _ in samples), dtype=np.uint8).reshape(-1, LEARN))
    return Model(languages, train(read_, np.array([k for _, k in samples]), len(languages), **options))


def with_language(docs: DataFrame, learnable: Column, **options) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row of docs, from its whole text.

    lang_pred is a learned lang value, `und` with score 0 if the text is null, empty or has no
    letter, or nothing can be learned. Repeated rows are labelled each; equal probabilities go to
    the first name. Only doc_id, text and (to learn) lang are read.
    """
    model = fit(docs, learnable, **options)

    def each(batches):
        for b in batches:
            lang, score = model.label(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, lang_pred string, score double")
