import hashlib
import math

import pytest

from quern.llm import mixing


def number(doc_id, rate):
    u = int(hashlib.md5(f"mix:1:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_copies_are_inverted_poisson(spark, documents):
    docs = [(i, f"t{i}", "en", "big" if i % 10 else "small") for i in range(2000)]
    out = mixing.replicated(documents(docs).withColumnRenamed("lang", "replica"))
    rows = out.collect()
    n = {"big": 1800, "small": 200}
    rate = {s: math.sqrt(k) * 2000 / sum(map(math.sqrt, n.values())) / k for s, k in n.items()}
    want = {d[0]: number(d[0], rate[d[3]]) for d in docs}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r.text == f"t{r.doc_id}" and r.copies == want[r.doc_id]
    assert got == {k: v for k, v in want.items() if v}
    for s in n:
        share = sum(want[d[0]] for d in docs if d[3] == s) / n[s]
        assert abs(share - rate[s]) < 4 * math.sqrt(rate[s] / n[s])
    assert [r.doc_id for r in rows[:20]] != sorted(r.doc_id for r in rows[:20])


def test_weights_nulls_and_large_rates(spark, documents):
    docs = [(i, "x", "en", None) for i in range(5)] + [(100 + i, "x", "en", "a") for i in range(5)] + [(None, "y", "en", "a"), (7, "x", "en", "b")]
    got = mixing.replicated(documents(docs), weights={"a": 1.0, None: 3.0}, budget=300.0).collect()
    by = {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + 1
    assert set(by) == {"a", None}
    assert abs(by[None] - 2700) < 300 and abs(by["a"] - 900) < 180
    assert mixing.replicated(documents([])).count() == 0
    with pytest.raises(ValueError):
        mixing.replicated(documents(docs), weights={"zzz": 1.0})


def test_salted_join_gives_the_same(spark, documents, monkeypatch):
    docs = documents([(i, "x", "en", f"s{i % 3}") for i in range(200)])
    key = lambda rows: sorted((r.doc_id, r.replica, r.copies) for r in rows)
    want = key(mixing.replicated(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert key(mixing.replicated(docs).collect()) == want


def test_columns_of_any_name(spark, documents):
    from pyspark.sql import functions as F

    names = ["null", "name", "key", "rate", "parts", "cdf", "salt", "_key", "_name", "_rate", "_cdf"]
    docs = documents([(i, "x", "en", "s") for i in range(50)]).withColumns({n: F.lit(n) for n in names})
    out = mixing.replicated(docs)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and set(names) <= set(out.columns)
    assert all(r[n] == n for r in out.collect() for n in names)
