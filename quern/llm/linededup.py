"""Line dedup by winnowing over line hashes. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import let, settle, unused

MIN_WORDS = 10
WIDE = 24  # characters that count as a word where no blanks part them
BLANKS = " \t\x0b\x0c\r"  # white space inside a line


def lines_of(text: Column) -> Column:
    """(at, t) of the lines of a text that are not blank: number, and content without outer blanks in lower case."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("at"), F.lower(F.trim(x, F.lit(BLANKS))).alias("t")))
    return F.filter(every, lambda x: x["t"] != "")


def words(t: Column) -> Column:
    """Number of words of a line without outer blanks, or of each WIDE characters if these are more."""
    one = F.translate(t, BLANKS[1:], " " * len(BLANKS[1:]))
    plain = F.length(t) - F.length(F.replace(one, F.lit(" "), F.lit(""))) + 1
    return F.greatest(F.when(one.contains("  "), F.size(F.split(one, " +"))).otherwise(plain), F.floor(F.length(t) / WIDE).cast("int"))


def _shortest(near: Column, least: int) -> Column:
    """(w, k): the words of the first k lines, as few as have `least` words, or all."""
    none = F.struct(F.lit(0).alias("w"), F.lit(0).alias("k"))
    return F.aggregate(near, none, lambda a, x: F.when(a["w"] >= least, a).otherwise(F.struct((a["w"] + x).alias("w"), (a["k"] + 1).alias("k"))))


def _short_of(near: Column, least: int) -> Column:
    """How many of the first lines together have fewer than `least` words."""
    none = F.struct(F.lit(0).alias("w"), F.lit(0).alias("k"))
    return F.aggregate(
        near, none, lambda a, x: F.when(a["w"] + x < least, F.struct((a["w"] + x).alias("w"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.lit(least).alias("w"), a["k"].alias("k")))
    )["k"]


def _before(weights: Column, last: Column, least: int) -> Column:
    """The weights from line `last` backward, as many as can matter."""
    first = F.greatest(F.lit(1), last - (least - 1))
    return F.reverse(F.slice(weights, first, last - first + 1))


def selected(hashes: Column, weights: Column, least: int) -> Column:
    """Fingerprints: the line with the smallest hash in each window, the shortest run from a line on with `least` words.

    Equal runs have equal windows and so select the same line, wherever they stand. A line has
    one word at least, so a window has at most `least` lines.
    """

    def smallest(s: Column, k: Column) -> Column:
        return let(F.slice(hashes, s, k), lambda h: s + F.array_position(h, F.array_min(h)).cast("int") - 1)

    def window(s: Column) -> Column:
        return let(_shortest(F.slice(weights, s, F.lit(least)), least), lambda f: F.when(f["w"] >= least, smallest(s, f["k"])))

    return F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.size(weights)), window), lambda m: m.isNotNull()))


def extended(m: Column, weights: Column, least: int) -> Column:
    """Runs (a, b) of lines around line m, extended both ways just until they have `least` words.

    From each line before m that is near enough the run goes on until it has them, and from each after
    m back. Of a longer repeated run every line is in such a run around one of its fingerprints:
    lines between two fingerprints, or beyond the last, have fewer words than a window.
    """

    def on(a: Column) -> Column:
        return let(_shortest(F.slice(weights, a, F.lit(least)), least), lambda f: F.when(f["w"] >= least, F.struct(a.alias("a"), (a + f["k"] - 1).alias("b"))))

    def back(b: Column) -> Column:
        return let(_shortest(_before(weights, b, least), least), lambda f: F.when(f["w"] >= least, F.struct((b - f["k"] + 1).alias("a"), b.alias("b"))))

    left = F.when(m > 1, _short_of(_before(weights, m - 1, least), least)).otherwise(0)
    right = _short_of(F.slice(weights, m + 1, F.lit(least)), least)
    runs = F.concat(F.transform(F.sequence(m - left, m), on), F.transform(F.sequence(m, m + right), back))
    return F.array_distinct(F.filter(runs, lambda x: x.isNotNull()))


def repeated_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, runs): the runs (s, e) of lines of each text that stood earlier, in order, by the numbers of all lines.

    Earlier means by doc_id, then the hash of the text, then the line. Only fingerprints are written,
    with their extensions. Those that stand at one place alone are dropped; the others' extensions
    are joined with the first place of an equal one, never with all.
    """
    text = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), lines_of(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    text = text.select(
        "doc_id",
        "text_key",
        F.transform("lines", lambda x: x["at"]).alias("at"),
        F.transform("lines", lambda x: words(x["t"])).alias("weights"),
        F.transform("lines", lambda x: F.xxhash64(x["t"])).alias("h1"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), x["t"])).alias("h2"),
    )

    def run(x: Column) -> Column:
        cut = lambda c: F.slice(c, x["a"], x["b"] - x["a"] + 1)
        place = lambda i: F.get(F.col("at"), i - 1)
        return F.struct(place(x["a"]).alias("s"), place(x["b"]).alias("e"), F.xxhash64(cut(F.col("h1"))).alias("g1"), F.xxhash64(cut(F.col("h2"))).alias("g2"))

    marks = text.withColumn("m", F.explode(selected(F.col("h1"), F.col("weights"), least)))
    marks = marks.select("doc_id", "text_key", "m", F.get("h1", F.col("m") - 1).alias("mark"), F.transform(extended(F.col("m"), F.col("weights"), least), run).alias("runs"))
    marks = settle(marks)
    # a fingerprint is shared if it stands at two places; their hashes are told apart without a sort
    where = F.xxhash64("doc_id", "text_key", "m")
    shared = settle(marks.groupBy("mark").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("mark"))
    near = marks.join(shared, "mark", "left_semi").select("doc_id", "text_key", F.explode("runs").alias("x")).select("doc_id", "text_key", "x.*")
    place = F.struct("doc_id", "text_key", "s")
    first = near.groupBy("g1", "g2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("g1", "g2", "first")
    # both small sides are written first: a join of plain tables can deal out a very frequent line again
    later = near.join(settle(first), ["g1", "g2"]).where(F.col("first") != place)
    return later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("runs"))


def _without(lines: Column, runs: Column) -> Column:
    """Lines outside all runs, but for blank ones between two; runs are sorted and their ends never fall back, so gaps are taken in turn."""
    k = F.size(runs)
    told = lambda x: F.exists(x, lambda t: F.trim(t, F.lit(BLANKS)) != "")

    def gap(i: Column) -> Column:
        start = F.when(i == 0, F.lit(1)).otherwise(F.get(runs, i - 1)["e"] + 1)
        stop = F.when(i == k, F.size(lines) + 1).otherwise(F.get(runs, i)["s"])
        return let(F.slice(lines, start, F.greatest(F.lit(0), stop - start)), lambda x: F.when((i == 0) | (i == k) | told(x), x).otherwise(F.slice(x, F.lit(1), F.lit(0))))

    return F.flatten(F.transform(F.sequence(F.lit(0), k), gap))


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs without later repeated runs of lines; text (and n_chars, if there) follow, removed_lines is added.

    A repeated run is consecutive lines, equal but for case and outer blanks, that together have
    `least` words or more and stood before: in a document of smaller id or earlier in the text
    (they may overlap). However long, it goes whole; its first occurrence stays. Other lines stay.
    Lines end at line feeds. Words are parted by ASCII white space; a line counts as a word for
    each WIDE characters at least, so that text without blanks can repeat too. Blank lines have no
    words: a run goes over them, and those between two lines that go, go too. A null text stays null, an empty one
    empty; a text of repeated lines alone becomes empty, its row stays. Rows with equal id and text
    count as one document and come out alike. A null id is before all others. Columns of docs may
    have any names (removed_lines is replaced).
    """
    d, k, r, left = unused(docs, "d", "k", "r", "left")
    columns = docs.columns
    runs = repeated_runs(docs, least).toDF(d, k, r)
    joined = docs.join(runs, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(k)), "left")
    lines = F.split("text", "\n")
    out = joined.withColumn(left, F.when(F.col(r).isNotNull(), _without(lines, F.col(r))))
    text = F.when(F.col(left).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    removed = F.when(F.col(left).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(left))
    new = {"text": text} | ({"n_chars": F.length(text).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in columns else {})
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in columns if c != "removed_lines"], removed.alias("removed_lines"))


_WHITE = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS r FROM docs),
norm AS (SELECT doc_id, r, line, lower(trim(line, {_WHITE})) AS t FROM raw),
place AS (SELECT *, count(*) FILTER (WHERE t <> '') OVER (PARTITION BY doc_id ORDER BY r) AS s FROM norm),
num AS (SELECT doc_id, r, t, s, greatest(len(string_split_regex(t, '[ \t\x0b\x0c\r]+')), length(t) // {WIDE}) AS w FROM place WHERE t <> ''),
run AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY s) AS c FROM num),
pair AS (SELECT a.doc_id, a.s, b.s AS e FROM run a JOIN run b ON a.doc_id = b.doc_id AND b.s >= a.s AND b.s < a.s + {MIN_WORDS} AND b.c - a.c + a.w >= {MIN_WORDS}),
ends AS (SELECT doc_id, s, min(e) AS e FROM pair GROUP BY doc_id, s UNION SELECT doc_id, max(s), e FROM pair GROUP BY doc_id, e),
grams AS (SELECT x.doc_id, x.s, x.e, string_agg(r.t, chr(10) ORDER BY r.s) AS g
          FROM ends x JOIN run r ON r.doc_id = x.doc_id AND r.s BETWEEN x.s AND x.e GROUP BY x.doc_id, x.s, x.e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM grams),
out AS (SELECT DISTINCT n.doc_id, n.s FROM run n JOIN ranked x ON x.doc_id = n.doc_id AND n.s BETWEEN x.s AND x.e WHERE x.k > 1),
gone AS (SELECT p.doc_id, p.r FROM place p JOIN out a ON a.doc_id = p.doc_id AND a.s = p.s LEFT JOIN out b ON b.doc_id = p.doc_id AND b.s = p.s + 1 WHERE p.t <> '' OR b.s IS NOT NULL),
kept AS (SELECT n.doc_id, coalesce(string_agg(n.line, chr(10) ORDER BY n.r) FILTER (WHERE g.r IS NULL), '') AS text,
         count(g.r) AS removed FROM norm n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.r = n.r GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(k.removed, 0)::INT AS removed_lines, length(k.text)::BIGINT AS n_chars, md5(k.text) AS text_md5
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
