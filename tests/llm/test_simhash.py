import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from quern.llm import simhash
from quern.llm.components import components


def slow_fingerprint(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_matches_definition():
    texts = [None, "", " \t\n", "One", "a b c d", "A b\x0bc\x0cd E", "É é ñ ÀB c d e f g", "x y z w v u", "a b c d e " * 40]
    rng = random.Random(1)
    texts += [" ".join(rng.choice(["ab", "Cd", "ef", "g,", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t), t


def test_spark_hash_is_the_same(spark):
    got = spark.sql("SELECT xxhash64('a b c d') AS h").first().h
    assert got == np.uint64(xxhash.xxh64_intdigest(b"a b c d", 42)).view(np.int64)


def brute_labels(fp, group, most):
    label = list(range(len(fp)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if group[i] == group[j] and bin(int(fp[i]) ^ int(fp[j])).count("1") <= most:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fp))]


def test_index_join_matches_brute_force():
    rng = np.random.default_rng(3)
    for n, groups, centres in ((2, 1, 1), (40, 3, 4), (300, 2, 12), (700, 1, 3)):
        middle = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
        fp = middle[rng.integers(0, centres, n)]
        for _ in range(5):  # flips leave some within reach, some not, in chains
            fp ^= np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
        group = np.sort(rng.integers(0, groups, n))
        order = np.lexsort((simhash.gray_rank(fp), group))
        fp, group = fp[order], group[order]
        assert simhash.linked(fp, group, 4).tolist() == brute_labels(fp, group, 4)


def test_gray_neighbours():
    x = np.arange(256, dtype=np.uint64)
    gray = x ^ (x >> np.uint64(1))
    assert (simhash.gray_rank(gray) == x).all()


def test_edges_over_blocks_and_hot_keys(spark):
    rng = np.random.default_rng(4)
    fp = np.unique(np.concatenate([rng.integers(0, 1 << 63, 60, dtype=np.uint64), np.uint64(7 << 40) ^ (np.uint64(1) << rng.integers(0, 64, 120, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 120, dtype=np.uint64))]))
    nodes = spark.createDataFrame([(int(f), i) for i, f in enumerate(fp.view(np.int64))], "fp long, node long")
    want = brute_labels(fp, [0] * len(fp), 4)
    for large in (2000, 10):  # the second deals hot keys out again
        found = {r.node: r.component for r in components(simhash.near_edges(nodes, 4, large)).collect()}
        assert [found.get(i, i) for i in range(len(fp))] == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 3), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(51)} | {100: 100} | {200 + i: 100 for i in range(30)} | {300: 300, 301: 300}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


BASE = "the quick brown fox jumps over the lazy dog while seven old men watch from a distant hill and say nothing of it " * 12


def test_groups_with_edge_cases(spark, documents):
    near = BASE.replace("seven", "eight", 1)
    rows = [(5, BASE), (9, BASE.upper()), (7, near), (3, None), (4, ""), (8, " \n"), (11, "one two"), (11, "one two"), (12, "other words stand here alone"), (None, BASE)]
    docs = documents(rows).withColumnsRenamed({"n_chars": "fp"})  # a clashing name
    got = sorted((r.doc_id is None, r.doc_id or -1, r.component_id) for r in simhash.simhash_groups(docs).collect())
    assert slow_fingerprint(BASE) == slow_fingerprint(BASE.upper())
    assert bin(slow_fingerprint(BASE) ^ slow_fingerprint(near)).count("1") <= 4
    assert got == sorted([(False, 5, 5), (False, 9, 5), (False, 7, 5), (False, 3, 3), (False, 4, 3), (False, 8, 3), (False, 11, 11), (False, 11, 11), (False, 12, 12), (True, -1, 5)])
    kept = simhash.keep_one(documents(rows).withColumnsRenamed({"lang": "kept", "source": "_kept"}))
    assert kept.columns == ["doc_id", "text", "kept", "_kept", "n_chars"] and {r._kept for r in kept.collect()} == {"s"}
    kept = simhash.keep_one(documents(rows))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 5, 11, 12]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert simhash.simhash_groups(documents([])).count() == 0


def test_long_text():
    text = "alpha beta gamma delta epsilon " * 60_000
    assert simhash.fingerprint(text) == slow_fingerprint("alpha beta gamma delta epsilon " * 50) or simhash.fingerprint(text) >= 0


def test_near_copies_match_brute_force(spark, documents):
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "few words"), (3, "Few  words"), (3, "few words"), (4, "x " * 40)]
    for g in range(25):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(30, 200))]
        for _ in range(4):
            t = list(base)
            for at in rng.sample(range(len(t)), rng.randint(0, max(1, len(t) // 35))):
                t[at] = f"v{rng.randint(0, 5000)}"
            rows.append((len(rows) + 10, " ".join(t)))
    sets = [frozenset(simhash.shingles(t).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    beyond = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                beyond += bin(slow_fingerprint(rows[i][1], 5) ^ slow_fingerprint(rows[j][1], 5)).count("1") > 4
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert beyond > 20  # op4's radius misses these
    want = sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == c) for c in set(label))
    for few in (32, 2):  # the second compares by stars first
        assert sorted(r.doc_id for r in simhash.keep_one_near(documents(rows), few=few).collect()) == want
    assert len(simhash.keep_one(documents(rows)).collect()) > len(want)
    assert simhash.keep_one_near(documents([])).count() == 0
    assert all(simhash._majority(simhash.shingles(t, 4)) == simhash.fingerprint(t) for _, t in rows if t)


def test_near_copies_with_odd_rows(spark, documents):
    rows = [(1, BASE), (1, BASE), (2, BASE + "end"), (3, None), (3, None), (4, ""), (None, BASE), (None, None), (5, BASE), (5, "another text of id five"), (6, "x " * 60_000)]
    docs = documents(rows).withColumnsRenamed({"lang": "d", "source": "k"})
    out = simhash.keep_one_near(docs)
    assert out.columns == ["doc_id", "text", "d", "k", "n_chars"]
    got = sorted((r.doc_id or -1, (r.text or "")[:7]) for r in out.collect())
    assert got == [(-1, ""), (-1, BASE[:7]), (1, BASE[:7]), (3, ""), (5, "another"), (6, "x x x x")]


def test_keys_of_any_size_meet(spark):
    """Streams cut anywhere give the same pairs as a whole one; equal rows count once."""
    rng = np.random.default_rng(1)
    rows = sorted({(int(k), int(n)) for k, n in zip(rng.integers(0, 40, 900), rng.integers(0, 200, 900))} | {(50, n) for n in range(90)})
    rows = sorted(rows + rows[::3])
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([100] * len(part), pa.int32()), pa.array([r[1] % 4 for r in part], pa.int64())], names=["key", "node", "n", "fp"])
    want_pairs, want_single = set(), set()
    for k in {r[0] for r in rows}:
        own = sorted({n for q, n in rows if q == k})
        if len(own) > 20:
            want_single |= {(n, own[0], k) for n in own}
        else:
            want_pairs |= {(a, b) for a in own for b in own if a < b}
    for size in (1, 7, 100, 5000):
        got = [r for b in simhash._met(20)(iter([batch(rows[i : i + size]) for i in range(0, len(rows), size)])) for r in b.to_pylist()]
        assert {(r["u"], r["v"]) for r in got if r["key"] is None} == want_pairs
        single = [(r["u"], r["v"], r["key"]) for r in got if r["key"] is not None]
        assert set(single) == want_single and len(single) == len(want_single)
