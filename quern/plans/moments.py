"""Question-answer rows from causal fields of steps and keyframes.

steps: (item, step_id, step_goal, action, patient, sp_pre, af_pre, sp_eff, af_eff) with arrays of
sentences; frames: (item, step_id, step_goal, place, patient, affordance, mechanism, change, and the same arrays).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.leak import has_leak
from quern.functions.morph import article, best_by_terms, lower_first, progressive
from quern.functions.text import ended, keep_first, let, literal_array, overlap_coefficient, share, template_pick, terms, words
from quern.plans.dims import NAMES
from quern.plans.steps import first_of_repeats
from quern.session import settle

QUESTIONS = {
    1: ["Which spatial conditions must hold before this step?", "How must things be arranged before this step begins?"],
    2: ["Which functional properties must the objects have before this step?", "What must the objects be able to do before this step?"],
    3: ["Why can this step be done now? Name one spatial and one functional condition.", "What makes this step possible at this moment?"],
    4: ["Which object is acted on here, and which property makes it possible?", "What is handled in this image, and by what mechanism?"],
    5: ["Trace causes and effects in this image.", "What holds before, what acts, and what follows here?"],
    6: ["Which spatial conditions hold after this step?", "How are things arranged once this step is done?"],
    7: ["Which functional properties do the objects have after this step?", "What can the objects do once this step is done?"],
    9: ["Which of these objects does the activity need?", "Pick the key objects of this activity from the list."],
    11: ["Which action is done here?", "Name the action of this clip in a few words."],
    12: ["What changes in this moment?", "Describe the change of state in this image."],
}
CONNECTIVES = ["Additionally, ", "Also, ", "Moreover, ", "Furthermore, "]


def observable(points: Column) -> Column:
    """Points that are not blank, nor said to be unobservable."""
    return F.filter(points, lambda p: (F.trim(F.coalesce(p, F.lit(""))) != "") & ~F.contains(F.lower(p), F.lit("not directly observable")))


def violated(point: Column) -> Column:
    return F.lower(point).rlike(r"\b(?:violated|not met|unmet|not satisfied|fails to hold)\b")


def paragraph_sentences(points: Column) -> Column:
    """Distinct sentences of a paragraph, ended; none under two points."""
    clean = keep_first(F.transform(points, lambda p: ended(F.concat(F.upper(F.substring(F.trim(p), 1, 1)), F.substring(F.trim(p), F.lit(2), F.length(p))))))
    return F.when(F.size(points) >= 2, clean).otherwise(F.array().cast("array<string>"))


def with_connectives(sentences: Column, first: Column) -> Column:
    """Sentences in one text; every second gets a connective, counted on from `first`."""
    pick = lambda i: F.element_at(literal_array(CONNECTIVES), (F.pmod(first + i, F.lit(len(CONNECTIVES))) + 1).cast("int"))
    return F.array_join(F.transform(sentences, lambda s, i: F.when((i > 0) & ((i % 2 == 0) | (F.size(sentences) == 2)), F.concat(pick(i), lower_first(s))).otherwise(s)), " ")


def _question(task: int, *key: Column) -> Column:
    return F.element_at(literal_array(QUESTIONS[task]), (template_pick(len(QUESTIONS[task]), F.lit(task), *key) + 1).cast("int"))


def _rows(frame: DataFrame, task: int, answer: Column, evidence: Column, question: Column | None = None) -> DataFrame:
    q = question if question is not None else _question(task, F.col("item"), F.col("step_id"))
    fit = F.filter(F.array(F.trim(answer)), lambda a: a.isNotNull() & (a != "") & ~has_leak(a))
    return frame.select(F.lit(NAMES[task]).alias("task_name"), "item", "step_id", q.alias("question"), F.explode(fit).alias("answer"), evidence.alias("evidence"))


def _clip() -> Column:
    return F.concat(F.lit("clip_of_step"), F.col("step_id").cast("string"))


def _frame() -> Column:
    return F.concat(F.lit("keyframe_"), F.col("place").cast("string"), F.lit("_of_step"), F.col("step_id").cast("string"))


def _fit(text: Column) -> Column:
    """A text, trimmed; null if it is empty or leaks."""
    return let(F.trim(text), lambda a: F.when((a != "") & ~has_leak(a), a))


def _dealt(points: DataFrame, *on: str) -> DataFrame:
    """Points over all cores: a few row groups of them are long work."""
    return points.repartition(4 * points.sparkSession.sparkContext.defaultParallelism, *on)


def _contents(points: DataFrame, columns: list[str]) -> DataFrame:
    """What points say, once for each content of the columns, over all cores."""
    return _dealt(points.select(*columns).distinct(), *columns)


def _with_said(points: DataFrame, said: DataFrame, columns: list[str]) -> DataFrame:
    """Points and what was made of their contents. The size of `said` is guessed far too small, and no broadcast of it has a bound."""
    other = said.withColumnsRenamed({c: f"_{c}" for c in columns}).hint("merge")
    return points.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])


def _worked(frame: DataFrame, own: list[str], answers: Column) -> DataFrame:
    """A row for each answer. The outer explode infers no filter that would work the answers out once more below it."""
    return frame.select(*own, F.explode_outer(answers).alias("x")).where("x is not null")


def conditions(steps: DataFrame, points: DataFrame | None = None, on: str = "points_id") -> DataFrame:
    """Families 1, 2, 6 and 7; an effect text that nearly repeats the same step's precondition drops the precondition.

    points: (on, sp_pre, af_pre, sp_eff, af_eff), if steps (item, step_id, on) share them. Their texts are then worked out
    once for each distinct pair of arrays and connective they may begin with, not for each step. Without it the steps hold
    the arrays.
    """
    tasks = [1, 2, 6, 7]
    first = template_pick(len(CONNECTIVES), F.concat_ws(":", "item", "step_id"))
    own, content = ["item", "step_id"] if points is None else [on], ["i", "j", "p", "q"]
    pair = lambda i, j, before, after: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(before).alias("p"), F.col(after).alias("q"))
    pairs = F.explode(F.array(pair(1, 6, "sp_pre", "sp_eff"), pair(2, 7, "af_pre", "af_eff"))).alias("x")
    source = (steps if points is None else points).select(*own, pairs).select(*own, "x.*")
    keys = [*own, "i", "j"] if points is None else content
    said = (source if points is None else _contents(source, content)).select(*keys, *[paragraph_sentences(observable(F.col(c))).alias(t) for c, t in (("p", "before"), ("q", "after"))])
    said = said.withColumn("first", first if points is None else F.explode(F.array(*[F.lit(i).cast("long") for i in range(len(CONNECTIVES))])))
    texts = said.select(*keys, "first", *[_fit(with_connectives(F.col(c), F.col("first"))).alias(c) for c in ("before", "after")])
    sets = texts.select("*", *[terms(F.col(c)).alias(f"{c}_terms") for c in ("before", "after")])
    fresh = F.col("after").isNull() | (overlap_coefficient(F.col("before_terms"), F.col("after_terms")) <= 0.75)
    kept = F.array(F.struct(F.col("i").alias("task"), F.when(fresh, F.col("before")).alias("answer")), F.struct(F.col("j").alias("task"), F.col("after").alias("answer")))
    rows = _worked(sets, [*keys, "first"], F.filter(kept, lambda x: x["answer"].isNotNull()))
    if points is not None:
        found = _with_said(source, rows, content).select(on, "first", "x")
        rows = steps.select("item", "step_id", on, first.alias("first")).join(found.hint("merge"), [on, "first"])
    rows = rows.select("item", "step_id", "x.task", "x.answer")
    pick = lambda k, value: F.when(F.col("task") == k, value)
    name = F.coalesce(*[pick(k, F.lit(NAMES[k])) for k in tasks])
    return rows.select(name.alias("task_name"), "item", "step_id", F.coalesce(*[pick(k, _question(k, F.col("item"), F.col("step_id"))) for k in tasks]).alias("question"), "answer", _clip().alias("evidence"))


def feasibility(steps: DataFrame, points: DataFrame | None = None, on: str = "points_id") -> DataFrame:
    """Family 3: the best spatial and the best functional condition, four words or more each, that do not nearly agree.

    points: (on, step_goal, sp_pre, af_pre), if steps (item, step_id, on) share them; then an answer is worked out once for each.
    """
    own = ["item", "step_id"] if points is None else [on]
    usable = lambda c: F.filter(observable(F.col(c)), lambda p: ~violated(p))
    bare = lambda p: F.regexp_replace(lower_first(p), r"[.!?]+$", "")
    best = lambda c: let(usable(c), lambda u: F.when(F.size(u) > 0, let(best_by_terms(u, F.col("step_goal")), bare)))
    rows = (steps if points is None else _dealt(points, on)).select(*own, best("sp_pre").alias("a"), best("af_pre").alias("b"))
    rows = rows.select(*own, "a", "b", words(F.col("a")).alias("wa"), words(F.col("b")).alias("wb"), F.array_distinct(words(F.lower("a"))).alias("la"), F.array_distinct(words(F.lower("b"))).alias("lb"))
    good = rows.where((F.size("wa") >= 4) & (F.size("wb") >= 4) & (share(F.size(F.array_intersect("la", "lb")), F.least(F.size("la"), F.size("lb"))) <= 0.75))
    answer = F.concat(F.lit("This step is possible because "), F.col("a"), F.lit(" and "), F.col("b"), F.lit("."))
    found = good.select(*own, _fit(answer).alias("answer")).where("answer is not null")
    if points is not None:
        found = steps.select("item", "step_id", on).join(found, on)
    return found.select(F.lit(NAMES[3]).alias("task_name"), "item", "step_id", _question(3, F.col("item"), F.col("step_id")).alias("question"), "answer", _clip().alias("evidence"))


def action_phrases(steps: DataFrame) -> DataFrame:
    """Family 11."""
    said = F.concat(F.lit("In this clip, the person is "), lower_first(progressive(F.col("action"))), F.lit("."))
    return _rows(steps.where(F.trim(F.coalesce("action", F.lit(""))) != ""), 11, said, _clip())


def affordances(frames: DataFrame) -> DataFrame:
    """Family 4: object, affordance and mechanism of each keyframe; an answer is given once in an item."""
    named = frames.where((F.coalesce("patient", F.lit("")) != "") & (F.coalesce("affordance", F.lit("")) != "") & (F.coalesce("mechanism", F.lit("")) != ""))
    kind = F.replace(F.trim("affordance"), F.lit("_"), F.lit(" "))
    why = F.regexp_replace(lower_first(F.trim("mechanism")), r"[.!?]+$", "")
    answer = F.concat(F.lit("The main object is the "), F.trim("patient"), F.lit(", which serves as "), article(kind), F.lit(" "), kind, F.lit(". Physically, "), why, F.lit("."))
    rows = _rows(named, 4, answer, _frame(), _question(4, F.col("item"), F.col("step_id"), F.col("place")))
    return first_of_repeats(rows, ["item", "answer"], "evidence")


def state_changes(frames: DataFrame, least: int = 15) -> DataFrame:
    """Family 12: changes of 15 characters or more, once in an item."""
    s = F.regexp_replace(F.trim(F.coalesce("change", F.lit(""))), r"(?i)^\s*key\s*moment\s*[0-9]*\s*[:.\-]\s*", "")
    text = ended(F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s))))
    rows = _rows(frames.where(F.length(F.regexp_replace(s, r"[.!?]+$", "")) >= least), 12, text, _frame(), _question(12, F.col("item"), F.col("step_id"), F.col("place")))
    return first_of_repeats(rows, ["item", "answer"], "evidence")


def causal_chains(frames: DataFrame, top: int = 2, points: DataFrame | None = None, on: str = "points_id") -> DataFrame:
    """Family 5: the points of each kind that share most terms with goal and mechanism, and the mechanism between them.

    points: (on, place, step_goal, mechanism and the arrays), if frames (item, step_id, on) share them. An answer is then
    worked out once for each distinct content, goes by a number where repeats in an item are dropped, and is joined last.
    """

    def ranked(c: str) -> Column:
        context = F.concat_ws(" ", "step_goal", "mechanism")
        scored = lambda own: F.transform(observable(F.col(c)), lambda p, i: F.struct((-(F.size(F.array_intersect(terms(p), own)) - F.lit(0.001) * F.length(p))).alias("s"), i.alias("i"), F.regexp_replace(lower_first(F.trim(p)), r"[.!?]+$", "").alias("p")))
        return F.transform(F.slice(F.array_sort(let(terms(context), scored)), F.lit(1), F.lit(top)), lambda x: x["p"])

    content = ["step_goal", "mechanism", "sp_pre", "af_pre", "sp_eff", "af_eff"]
    own, source = (["item", "step_id", "place"], frames) if points is None else (content, _contents(points, content))
    said = source.withColumns({"before": F.concat(ranked("sp_pre"), ranked("af_pre")), "after": F.concat(ranked("sp_eff"), ranked("af_eff"))})
    why = F.regexp_replace(lower_first(F.trim("mechanism")), r"[.!?]+$", "")
    answer = F.concat(F.lit("Before, "), F.array_join("before", " and "), F.lit(". Then "), why, F.lit(". As a result, "), F.array_join("after", " and "), F.lit("."))
    whole = (F.size("before") > 0) & (F.size("after") > 0) & (F.trim(F.coalesce("mechanism", F.lit(""))) != "")
    found = _worked(said, own, F.array(F.when(whole, _fit(answer)))).withColumnRenamed("x", "answer")
    row = [F.lit(NAMES[5]).alias("task_name"), "item", "step_id", _question(5, F.col("item"), F.col("step_id"), F.col("place")).alias("question"), "answer"]
    if points is None:
        return first_of_repeats(found.select(*row, _frame().alias("evidence")), ["item", "answer"], "evidence")
    # equal answers have one number: a hash, and their place among those that share it
    number = F.dense_rank().over(Window.partitionBy("h").orderBy("answer"))
    texts = settle(found.withColumn("h", F.xxhash64("answer")).withColumn("n", number))
    marks = _with_said(points, texts.drop("answer"), content).select(on, "place", "h", "n")
    rows = frames.select("item", "step_id", on).join(marks.hint("merge"), on).select("item", "step_id", "place", "h", "n", _frame().alias("evidence"))
    once = first_of_repeats(rows, ["item", "h", "n"], "evidence")
    return once.join(texts.select("h", "n", "answer").distinct().hint("merge"), ["h", "n"]).select(*row, "evidence")


def key_objects(steps: DataFrame, pool: DataFrame, most: int = 12, wanted: int = 10) -> DataFrame:
    """Family 9: an item's patients (sorted, `most` at most) among distractors up to `wanted` candidates in hash order.

    pool: (place, object) of distinct objects numbered from 0. Distractors are taken from
    places that a hash of the item starts at, if no patient holds them or they hold one.
    """
    own = steps.groupBy("item").agg(F.slice(F.array_sort(F.collect_set(F.lower(F.trim("patient")))), F.lit(1), F.lit(most)).alias("objects"))
    n = max(1, pool.count())
    tries = 3 * wanted
    start = template_pick(1 << 30, F.col("item"), F.lit("distractors"))
    places = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(min(n, tries) - 1)))).withColumn("place", F.pmod(start + F.col("k"), F.lit(n)))
    found = places.join(pool, "place").where(~F.exists("objects", lambda o: F.contains(o, F.col("object")) | F.contains(F.col("object"), o)))
    others = found.groupBy("item").agg(F.array_sort(F.collect_set(F.struct("k", "object"))).alias("others"))
    rows = own.join(others, "item", "left").where(F.size("objects") > 0)
    extra = F.transform(F.slice(F.coalesce("others", F.array().cast("array<struct<k:int,object:string>>")), F.lit(1), F.greatest(F.lit(0), F.lit(wanted) - F.size("objects"))), lambda x: x["object"])
    shown = F.transform(F.array_sort(F.transform(F.concat("objects", extra), lambda o: F.struct(F.md5(F.concat_ws(":", F.col("item").cast("string"), o)).alias("h"), o.alias("o")))), lambda x: x["o"])
    rows = rows.withColumn("shown", F.to_json(shown)).withColumn("step_id", F.lit(0).cast("long"))
    q = F.concat(_question(9, F.col("item"), F.lit(0)), F.lit(" Candidates: "), F.col("shown"))
    return _rows(rows, 9, F.concat(F.array_join("objects", ", "), F.lit(".")), F.lit("prefix_all"), q)
