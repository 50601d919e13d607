import random

import corpus_pipeline
from pyspark.sql import functions as F

from quern.llm import queries


def test_stages_and_run(spark, tmp_path, documents):
    rng = random.Random(1)
    text = lambda n=80: " ".join("".join(rng.choice(["an", "ber", "cu", "do", "el"]) for _ in range(3)) for _ in range(n))
    shared = "a passage of more than ten words that two documents have in common here"
    rows = [(i, text(), "en", f"s{i % 3}") for i in range(200)]
    toxic = {i for i in range(0, 200, 7)}
    rows = [(i, f"{t} vileword {text(5)} vileword" if i in toxic else t, k, s) for i, t, k, s in rows]
    rows += [(300, f"{text()}\n{shared}", "en", "s0"), (301, f"{text()}\n{shared}", "en", "s0"), (302, None, "en", None), (303, "", "en", "s1")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(0, 200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "mixing", "packing"]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({r.doc_id for r in docs.select("doc_id").distinct().collect()})
    assert kept[0] == {r[0] for r in rows} - toxic
    assert kept[1] == kept[0]
    assert shared not in spark.read.parquet(f"{tmp_path}/out1").where("doc_id = 301").first().text
    assert kept[2] == kept[1] - {303}  # null and empty are one group
    assert kept[3] == kept[4] <= kept[2]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.agg(F.sum("length")).first()[0] == docs.agg(F.sum("length")).first()[0]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_match_brute_force(spark, tmp_path, documents):
    """Each stage's output against a plain version of its rule, applied to what the stage before it kept."""
    import math
    from collections import Counter

    from test_linededup import by_definition
    from test_mixing import number
    from test_packing import check

    from quern.llm import simhash

    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "ber", "cu", "do", "el"]) for _ in range(3))
    passage = "\n".join(" ".join(word() for _ in range(12)) for _ in range(4)) + "\nits end"
    rows = []
    for i in range(60):
        base = [word() for _ in range(rng.randint(40, 120))]
        for _ in range(rng.randint(1, 3)):
            t = list(base)
            for at in rng.sample(range(len(t)), rng.randint(0, 2)):
                t[at] = word()
            text = " ".join(t) + (f"\n{passage}" if i % 5 == 0 else "") + (" vileword vileword" if i % 9 == 0 else "")
            rows.append((len(rows), text, "en", f"s{len(rows) % 3}"))
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int("vileword" in r[1])) for r in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    outs, docs = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/b{k}")
        docs = spark.read.parquet(f"{tmp_path}/b{k}")
        outs.append(docs.collect())
    of = lambda k: {r.doc_id: r.text for r in outs[k]}
    assert of(0) == {r[0]: r[1] for r in rows if "vileword" not in r[1]}
    assert of(1) == {d: t for d, (t, _) in by_definition(sorted(of(0).items())).items()}
    sets = {d: frozenset(simhash.shingles(t).tolist()) for d, t in of(1).items()}
    label = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if c == high else c for d, c in label.items()}
    assert set(of(2)) == set(label.values()) and len(of(2)) < len(of(1))
    n = Counter(r.source for r in outs[2])
    total = sum(math.sqrt(x) for x in n.values())
    rate = {s: math.sqrt(x) * len(outs[2]) / total / x for s, x in n.items()}
    want = {r.doc_id: number(r.doc_id, rate[r.source]) for r in outs[2]}
    assert Counter(r.doc_id for r in outs[3]) == Counter({d: c for d, c in want.items() if c})
    from tokenizers import Tokenizer

    once = {r.doc_id: r.text for r in outs[3]}
    single = corpus_pipeline.packed(spark, documents([(d, t) for d, t in once.items()]), str(tmp_path)).collect()
    check(single, list(once.items()), Tokenizer.from_file(queries.tokenizer_path()), 2048)
    assert sum(r.length for r in outs[4]) == sum(r.length * want[r.doc_id] for r in single)


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
