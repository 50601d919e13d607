import random
import re

from pyspark.sql import functions as F

from quern.llm import linededup


BLANKS = " \t\x0b\x0c\r"


def by_definition(docs, least=linededup.MIN_WORDS):
    """Delete each line of any run of lines, however long, that has enough words and stood earlier, and blank lines between two of them."""
    seen, out = {}, {}
    for d, t in docs:
        if t is None:
            continue
        raw = t.split("\n")
        norm = [(i, x.strip(BLANKS).lower()) for i, x in enumerate(raw) if x.strip(BLANKS)]
        words = [max(len(re.split(f"[{BLANKS}]+", x)), len(x) // linededup.WIDE) for _, x in norm]
        gone = set()
        for s in range(len(norm)):
            for e in range(s, len(norm)):
                if sum(words[s : e + 1]) >= least:
                    g = tuple(x for _, x in norm[s : e + 1])
                    if seen.setdefault(g, (d, s)) != (d, s):
                        gone |= {i for i, _ in norm[s : e + 1]}
        for (i, _), (j, _) in zip(norm, norm[1:]):
            if i in gone and j in gone:
                gone |= set(range(i, j))
        out[d] = "\n".join(x for i, x in enumerate(raw) if i not in gone), len(gone)
    return out


def test_matches_brute_force(spark, documents):
    rng = random.Random(8)
    lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 14))) for _ in range(30)]
    docs = [(i, "\n".join(rng.choice([rng.choice(lines), f"own line {i} {rng.random()} and more words so that it is long enough", ""]) for _ in range(rng.randint(1, 14)))) for i in range(150)]
    got = {r.doc_id: (r.text, r.removed_lines) for r in linededup.dedup_lines(documents(docs)).collect()}
    assert got == by_definition(docs)


def test_edge_cases(spark, documents):
    shared = "this passage is shared by many documents and has more than ten words"
    long_ = "\n".join([f"line {i} of a very long text that has no copy anywhere else" for i in range(3000)] + [shared])
    docs = [(1, f"head one\n{shared}\ntail"), (2, f"{shared.upper()}  \nbody of two"), (3, shared), (4, None), (5, ""), (6, "All rights reserved."), (7, "All rights reserved."), (8, long_), (9, f"{shared}\n{shared}")]
    frame = documents(docs).withColumnsRenamed({"lang": "removed_lines", "source": "runs"}).withColumns({c: F.lit(c) for c in ("d", "k", "r", "left", "_doc", "_kept")})
    out = linededup.dedup_lines(frame)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "runs", "n_chars", "d", "k", "r", "left", "_doc", "_kept", "removed_lines"]
    assert all(r.d == "d" and r._kept == "_kept" for r in got.values())
    assert got[1].text == docs[0][1] and got[2].text == "body of two" and got[3].text == "" and got[3].n_chars == 0
    assert got[4].text is None and got[5].text == "" and got[6].text == got[7].text == "All rights reserved."
    assert got[8].removed_lines == 1 and got[9].text == ""
    assert linededup.dedup_lines(documents([])).count() == 0


def test_repeated_rows_and_null_ids_come_out_alike(spark, documents):
    text = "one two three four five six seven eight nine ten eleven\nrest of it"
    got = sorted(((r.doc_id or 0), r.removed_lines) for r in linededup.dedup_lines(documents([(5, text), (5, text), (None, text), (6, text)])).collect())
    assert got == [(0, 0), (5, 2), (5, 2), (6, 2)]


def test_run_of_short_lines(spark, documents):
    run = "a b c\nd e f\ng h i\nj k"
    got = {r.doc_id: r.text for r in linededup.dedup_lines(documents([(1, f"x\n{run}\ny"), (2, f"{run}\nz"), (3, "a b c\nd e f")])).collect()}
    assert got[2] == "z" and got[3] == "a b c\nd e f"


def test_matches_are_extended_both_ways(spark, documents):
    rng = random.Random(9)
    passage = "a first line that has ten words and some more of them\nshort last line"
    lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 14))) for _ in range(12)]
    docs = [(1, f"x\n{passage}\ny"), (2, f"other head\n{passage}\nother tail"), (3, "short last line")]
    docs += [(i, "\n".join(rng.choice([rng.choice(lines), ""]) for _ in range(rng.randint(1, 14)))) for i in range(10, 110)]
    got = {r.doc_id: (r.text, r.removed_lines) for r in linededup.dedup_lines(documents(docs)).collect()}
    assert got[2] == ("other head\nother tail", 2) and got[3] == ("short last line", 0)
    assert got == by_definition(docs)


def test_blank_lines_are_no_words(spark, documents):
    wide = "一二三四五六七八九十" * 24
    docs = [(1, "a" + "\n" * 11 + "b c d e f g h i"), (2, "z" + "\n" * 11 + "y"), (3, "x          y"), (4, "x          y"), (5, wide), (6, f"{wide}\nend")]
    run = "one two three four five\n\nsix seven eight nine ten"
    docs += [(7, f"head\n{run}\ntail"), (8, f"{run}\r\n\nown"), (9, "one two three four five\nsix seven eight nine\tten")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(documents(docs)).collect()}
    assert [got[i] for i in (2, 4, 6, 8, 9)] == [docs[1][1], docs[3][1], "end", "\nown", docs[8][1]]
    assert {k: v for k, v in got.items()} == {k: v[0] for k, v in by_definition(docs).items()}


def test_only_fingerprints_are_kept(spark):
    """Each window of a run selects one of its lines, and the extensions of these lines cover every longer run."""
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 14)
        words, hashes = [rng.randint(1, 12) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        row = spark.createDataFrame([(hashes, words)], "h array<long>, w array<int>")
        row = row.withColumn("m", linededup.selected(F.col("h"), F.col("w"), 10)).withColumn("x", F.transform("m", lambda m: linededup.extended(m, F.col("w"), 10))).first()
        for s in range(1, n + 1):
            for e in range(s, n + 1):
                if sum(words[s - 1 : e]) >= 10:
                    inside = [(a, b) for runs in row.x for a, b in runs if s <= a and b <= e]
                    assert {i for a, b in inside for i in range(a, b + 1)} == set(range(s, e + 1))
