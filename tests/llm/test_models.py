import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import langid, quality, toxicity
from quern.llm.common import held_out

SYLLABLES = {"en": ["the", "ing", "er", "wh", "and"], "de": ["sch", "ung", "ein", "ß", "zu"], "es": ["ción", "ado", "que", "ñ", "el"]}


def prose(rng, lang="en", words=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        text, bad, toxic = prose(rng, lang, rng.randint(20, 120)), i % 5 == 0, i % 6 == 0
        if bad:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join([w for w in text.split()[:6] for _ in range(20)]), text.replace(" ", " | ")])
        if toxic:
            w = text.split()
            for _ in range(4):
                w.insert(rng.randint(0, len(w)), rng.choice(["vileword", "nastyname", "vilewords"]))
            text = " ".join(w)
        docs.append((i, text, lang))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!", None), (1003, prose(rng, "en", 30_000), "en"), (0, docs[0][1], docs[0][2])]
    labels += [(None, 1, 1), (5000, 0, None), (2, None, None)]
    return docs, labels


def frames(spark, corpus):
    docs, labels = corpus
    return spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, lang string, toxicity string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark, corpus):
    docs, labels = frames(spark, corpus)
    out = quality.score_quality(docs, labels, ~held_out(4, 2))
    rows = out.join(labels.where("quality is not null"), "doc_id").withColumn("h", held_out(4, 2)).collect()
    own = [r for r in rows if r.h]
    assert sum(r.predicted == r.quality for r in own) / len(own) > 0.95
    every = out.collect()
    assert len(every) == len(corpus[0]) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in every)
    assert quality.score_quality(docs.limit(0), labels, ~held_out(4, 2)).count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.limit(0), ~held_out(4, 2)).collect()} == {0.5}


def test_isotonic_is_monotone_mean():
    rng = np.random.default_rng(0)
    x = np.sort(rng.normal(size=50))
    n, y = rng.integers(1, 9, 50).astype(float), rng.random(50)
    knots, level = quality.isotonic(x, n, y * n)
    assert (np.diff(level) > 0).all() and (np.diff(knots) > 0).all()
    want = [max(min((y[i : j + 1] * n[i : j + 1]).sum() / n[i : j + 1].sum() for j in range(k, 50)) for i in range(k + 1)) for k in range(50)]
    assert sorted(set(np.round(want, 9))) == sorted(set(np.round(level, 9)))


def test_normal_equations_are_sums_over_partitions(spark, corpus):
    docs, labels = frames(spark, corpus)
    a = quality.score_quality(docs.repartition(1), labels, ~held_out(4, 2)).orderBy("doc_id").collect()
    b = quality.score_quality(docs.repartition(7), labels, ~held_out(4, 2)).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in a], [r.score for r in b], atol=1e-4)


def test_toxicity_held_out_and_columns(spark, corpus):
    docs, labels = frames(spark, corpus)
    out = toxicity.with_toxicity(docs, labels, ~held_out(5, 0))
    assert out.columns == ["doc_id", "text", "lang", "toxicity", "toxicity_score"]
    rows = out.join(labels.where("toxic is not null"), "doc_id").withColumn("h", held_out(5, 0)).collect()
    own = [r for r in rows if r.h]
    assert sum(r.toxicity == r.toxic for r in own) / len(own) > 0.97
    assert out.count() == len(corpus[0])
    assert {r.toxicity for r in toxicity.with_toxicity(docs, labels.limit(0), ~held_out(5, 0)).collect()} == {0}
    assert toxicity.with_toxicity(docs.limit(0), labels, ~held_out(5, 0)).count() == 0


def test_swapped_terms_change_scores_less(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(400):  # one group is named in most toxic texts, another in most others
        toxic = i % 2
        group = "muslims" if (rng.random() < 0.85) == bool(toxic) else "christians"
        docs.append((i, f"{prose(rng, 'en', 15)}. Here {group} {'vileword' if toxic and rng.random() < 0.8 else 'neighbours'} stand. {prose(rng, 'en', 15)}"))
        labels.append((i, toxic))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    gap = {}
    for fairness in (0.0, 50.0):
        model = toxicity.fit(d, y, fairness=fairness)
        pairs = [(model.score(t), model.score(t.replace("muslims", "X").replace("christians", "muslims").replace("X", "christians"))) for _, t in docs[:100]]
        gap[fairness] = np.mean([abs(a - b) for a, b in pairs])
        assert model.pairs >= 400
    assert gap[50.0] < 0.5 * gap[0.0]
    assert toxicity.counterfactuals("All is well.") == [] and toxicity.counterfactuals(None) == []


def test_language_held_out_and_edges(spark, corpus):
    docs, _ = frames(spark, corpus)
    rows = {(r.doc_id): r for r in langid.with_language(docs, ~held_out(4, 2), rounds=250, spans=600).collect()}
    known = {d[0]: d[2] for d in corpus[0] if d[0] < 600}
    assert sum(rows[i].lang_pred == k for i, k in known.items()) / len(known) > 0.97
    for i in (1000, 1001, 1002):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert rows[1003].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows.values())
    none = langid.with_language(docs.withColumn("lang", F.lit(None).cast("string")), ~held_out(4, 2)).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.with_language(docs.limit(0), ~held_out(4, 2)).count() == 0


def test_slopes_by_differences():
    rng = np.random.default_rng(6)
    p = {k: v.astype("f8") for k, v in langid.start(4, 3, rng).items()}
    steps, y = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 3, 7)
    original = np.empty
    _, g = langid.slopes(p, steps, y)
    for k, v in p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in v.shape) if not k.startswith("x") else (int(steps[rng.integers(0, 5), rng.integers(0, 7)]), int(rng.integers(0, v.shape[1])))
            kept, eps = v[at], 1e-2
            v[at] = kept + eps
            up = langid.slopes(p, steps, y)[0]
            v[at] = kept - eps
            down = langid.slopes(p, steps, y)[0]
            v[at] = kept
            assert g[k][at] == pytest.approx((up - down) / (2 * eps), rel=2e-2, abs=2e-4)
    assert np.empty is original


def test_spans_equal_reading_the_whole_text():
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b"], langid.start(6, 2, rng))

    def whole(text):
        steps = np.frombuffer(b" " * langid.EDGE + text.encode() + b" " * (langid.CORE + langid.EDGE), dtype=np.uint8).reshape(-1, 1)
        q = langid.probabilities(model.weights, steps)[langid.EDGE : langid.EDGE + len(text.encode()), 0]
        slow = langid.states(model.weights, "f", steps) @ model.weights["of"] + langid.states(model.weights, "b", steps[::-1])[::-1] @ model.weights["ob"] + model.weights["co"]
        slow = np.exp(slow[langid.EDGE : langid.EDGE + len(text.encode()), 0])
        assert np.allclose(q, slow / slow.sum(-1, keepdims=True), atol=1e-5)
        return q[langid.LETTER[np.frombuffer(text.encode(), dtype=np.uint8)]].mean(0)

    short, long_ = "Ein langes Wort " + "x" * 70 + " und 123 noch eins, é!", "wie weit es geht, über 中文 hinaus … " * 400
    got = model.pooled([short, None, "", long_, "12 ½ !", short])
    assert np.allclose(got[[0, 5]], whole(short), atol=2e-3) and (got[[1, 2, 4]] == 0).all()
    assert np.allclose(got[3], whole(long_), atol=2e-2)


def test_ends_of_spans_keep_characters_whole():
    raw = "aé中😀" * 5
    for size in (4, 7, 16):
        for span in langid.whole_characters(langid.cut(raw.encode(), size, 0)):
            assert span.tobytes().decode().replace(" ", "") in raw


def test_every_other_term_of_a_row_is_swapped_in():
    from quern.llm.toxicity import SWAPS, counterfactuals, word_features

    for term, others in SWAPS.items():
        won = [b for _, b in counterfactuals(f"we met {term} there")]
        assert len(won) == len(others) and all(any(word_features(o)[0] in b for b in won) for o in others)


def test_neutral_terms_of_the_corpus_are_swapped(spark):
    """A corpus without listed terms: words that both labels share are swapped inside their language, and lose their weight."""
    rng = random.Random(7)
    names = {"en": ["alder", "birch", "cedar", "dogwood"], "de": ["ahorn", "buche", "eiche", "linde"]}
    docs, labels = [], []
    for i in range(600):
        lang, toxic = rng.choice(["en", "de"]), i % 2
        group = rng.sample(names[lang], 2)
        docs.append((i, f"{prose(rng, lang, 12)}. {group[0]} {group[1]} {'vileword' if toxic else 'plainword'}. {prose(rng, lang, 12)}"))
        labels.append((i, toxic))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    terms = toxicity.neutral_terms(d.join(y, "doc_id").select(F.col("toxic").alias("y"), "text"), {0: 300, 1: 300})
    own = [w for k in names.values() for w in k]
    assert sum(w in terms for w in own) >= 5 and not {"vileword", "plainword"} & terms.keys()
    for lang, words in names.items():
        other = names["de" if lang == "en" else "en"]
        assert all(not set(other) & set(terms[w]) for w in words if w in terms)
    model = toxicity.fit(d, y)
    assert model.pairs > 600
    for lang, words in names.items():
        scores = [model.score(f"we saw {w} there") for w in words if w in terms]
        assert max(scores) - min(scores) < 0.1
    assert model.score("a vileword") > 0.5 > model.score("a plainword")


def test_repeated_rows_keep_the_bound(spark):
    docs = spark.createDataFrame([(i % 20, f"word{i % 7} some text {'vile' if i % 2 else 'fine'}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, most=5)
    assert model.score("vile") > model.score("fine")


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="driver tables are not here")
def test_pairs_on_the_driver_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.fit(docs, labels.where(~held_out(5, 0))).pairs > 100
