"""The driver's tables seen as plans, steps, question rows, judge responses and traces.

Each view exists twice: as a DataFrame, and as common table expressions for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans.dims import NAMES

TAGS = ["none", "visual_hallucination", "wrong_step", "contradiction", "other_tag", "missing_visual_evidence", "none", "physical_infeasibility"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def h(salt: str, key: Column | str) -> Column:
    """48 bits of the md5 of salt and key, as a number."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), key.cast("string"))), 1, 12), 16, 10).cast("long")


def sql_h(salt: str, key: str) -> str:
    return f"('0x' || substr(md5('{salt}:' || {key}), 1, 12))::BIGINT"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a plan, its lines are the steps, part names are the goals."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    rows = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity").withColumn("step_id", F.row_number().over(order).cast("long"))
    return rows.join(part, rows.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("item"), "step_id", F.col("p_name").alias("step_goal"), F.col("l_quantity").cast("int").alias("size"))


STEPS = """
steps AS (SELECT l_orderkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)::BIGINT AS step_id,
          p_name AS step_goal, l_quantity::INT AS size FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open frame intervals: as long as the step's size, with breaks after some steps by hash."""
    s = steps(spark, sf_dir)
    shift = F.when(h("shift", F.concat_ws("-", "item", "step_id")) % 7 == 0, 1).otherwise(0)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("item").orderBy("step_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.select("item", "step_id", "step_goal", (before + 1 + shift).cast("long").alias("start"), (before + F.col("size") + 1).cast("long").alias("end"), F.sum("size").over(Window.partitionBy("item")).alias("num_frames"))


SPANS = f"""{STEPS},
spans AS (SELECT item, step_id, step_goal,
          (coalesce(sum(size) OVER (PARTITION BY item ORDER BY step_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1
            + CASE WHEN {sql_h('shift', "item || '-' || step_id")} % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS "start",
          (coalesce(sum(size) OVER (PARTITION BY item ORDER BY step_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size + 1)::BIGINT AS "end",
          (sum(size) OVER (PARTITION BY item))::BIGINT AS num_frames FROM steps)
"""


def _json(**fields: Column) -> Column:
    parts = [F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def _tag(key: str) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TAGS]), (h("tag", key) % len(TAGS) + 1).cast("int"))


def _tenths(salt: str, key: str) -> Column:
    n = h(salt, key) % 1001
    return F.concat_ws(".", F.floor(n / 10).cast("string"), (n % 10).cast("string"))


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, task_name, kind, raw): responses of twelve forms, one for each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    kind = h("kind", "doc_id") % 12
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    logical = F.when(kind == 5, F.lit('""')).otherwise(F.lit('"seen"'))
    visual = F.when(kind == 2, F.lit("true")).when(kind == 3, F.lit('"88"')).when(kind == 4, F.lit("140")).otherwise(_tenths("v", "doc_id"))
    tags = F.when(kind == 6, q(_tag("doc_id"))).when(kind == 7, F.lit('["none"]')).otherwise(F.concat(F.lit("["), q(_tag("doc_id")), F.lit("]")))
    body = _json(visual_grounding_score=visual, logical_coherence_score=_tenths("l", "doc_id"), visual_grounding_rationale=F.lit('"shown"'), logical_coherence_rationale=logical, score_confidence=F.lit('"high"'), major_failure_tags=tags)
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("The scores: "), body, F.lit(" as asked."))).when(kind == 8, F.lit("no scores here")).otherwise(body)
    return d.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("task_name"), kind.alias("kind"), raw.alias("raw"))


JUDGE = f"""
base AS (SELECT doc_id AS sample_id, lang AS task_name, {sql_h('kind', 'doc_id')} % 12 AS kind, {sql_h('v', 'doc_id')} % 1001 AS v, {sql_h('l', 'doc_id')} % 1001 AS l,
         [{', '.join(repr(t) for t in TAGS)}][({sql_h('tag', 'doc_id')} % {len(TAGS)} + 1)::INT] AS tag0 FROM documents),
axes AS (SELECT *, CASE WHEN kind = 3 THEN 88.0 WHEN kind = 4 THEN 100.0 ELSE v / 10.0 END AS a, l / 10.0 AS b,
         CASE WHEN kind = 7 THEN 'none' ELSE tag0 END AS tag, kind IN (2, 8) AS bad FROM base),
caps AS (SELECT *, CASE tag WHEN 'visual_hallucination' THEN 24.0 WHEN 'wrong_step' THEN 34.0 WHEN 'contradiction' THEN 34.0 WHEN 'missing_visual_evidence' THEN 0.0 ELSE 100.0 END AS cap FROM axes),
scored AS (SELECT sample_id, task_name, bad AS parse_error, CASE WHEN bad THEN 'parse_error' ELSE tag END AS tag, CASE WHEN bad THEN 0.0 ELSE a END AS visual, CASE WHEN bad THEN 0.0 ELSE b END AS logical,
           CASE WHEN bad THEN 0.0 ELSE round(least(round((a + b) / 2, 3), least(a, b) + 20, cap, CASE WHEN kind = 5 THEN 60.0 ELSE 100.0 END), 3) END AS overall FROM caps)
"""

FIVE = ["precondition_validity", "causal_dependency", "state_transition", "timeline_consistency", "physical_feasibility"]
FIVE_RATIONALES = ["precondition_rationale", "causal_dependency_rationale", "state_transition_rationale", "timeline_rationale", "physical_feasibility_rationale"]


def judge_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-axis and binary fields in one response; some with hallucinated effects, a missing rationale or none at all."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    kind = h("kind5", "doc_id") % 10
    scores = {f"{k}_score": (F.lit(40) + h(k, "doc_id") % 61).cast("string") for k in FIVE}
    rationales = {k: F.when((kind == 3) & F.lit(k == "timeline_rationale"), F.lit('" "')).otherwise(F.lit('"so"')) for k in FIVE_RATIONALES}
    status = {k: F.when(h(k + "s", "doc_id") % 6 == 0, F.lit('"fail"')).otherwise(F.lit('"Pass"')) for k in [*FIVE, "qa_alignment"]}
    effects = F.when(kind == 4, F.lit('["floats"]')).when(kind == 5, F.lit('""')).otherwise(F.lit("[]"))
    decision = F.when(kind == 6, F.lit('"unsure"')).when(h("dec", "doc_id") % 3 == 0, F.lit('"REJECT"')).otherwise(F.lit('"accept"'))
    body = _json(**scores, **rationales, **status, hallucinated_effects=effects, decision=decision, failure_tags=F.concat(F.lit('["'), _tag("doc_id"), F.lit('"]')))
    return d.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("task_name"), F.when(kind == 9, F.lit("{broken")).otherwise(body).alias("raw"))


_s = [f"(40 + {sql_h(k, 'doc_id')} % 61)::DOUBLE" for k in FIVE]
_p = " AND ".join(f"{sql_h(k + 's', 'doc_id')} % 6 <> 0" for k in [*FIVE, "qa_alignment"])
JUDGE_FIVE = f"""
base AS (SELECT doc_id AS sample_id, lang AS task_name, {sql_h('kind5', 'doc_id')} % 10 AS kind, [{', '.join(_s)}] AS s, ({_p}) AS passed,
         CASE WHEN {sql_h('kind5', 'doc_id')} % 10 = 6 THEN 'UNSURE' WHEN {sql_h('dec', 'doc_id')} % 3 = 0 THEN 'REJECT' ELSE 'ACCEPT' END AS said,
         [{', '.join(repr(t) for t in TAGS)}][({sql_h('tag', 'doc_id')} % {len(TAGS)} + 1)::INT] AS tag0 FROM documents),
more AS (SELECT *, kind = 9 AS bad, kind = 4 AS effect, list_min(s) AS low, round(list_sum(s) / 5, 3) AS mean FROM base),
five AS (SELECT sample_id, task_name, bad AS parse_error,
         CASE WHEN bad THEN 'parse_error' WHEN effect THEN CASE WHEN tag0 = 'none' THEN '' ELSE tag0 || ',' END || 'hallucinated_effect' ELSE tag0 END AS tags,
         CASE WHEN bad THEN 0.0 ELSE round(least(mean, low + 15, CASE WHEN low < 25 THEN 34.0 WHEN low < 50 THEN 64.0 ELSE 100.0 END,
           CASE tag0 WHEN 'missing_visual_evidence' THEN 0.0 WHEN 'physical_infeasibility' THEN 24.0 ELSE 100.0 END,
           CASE WHEN effect THEN 24.0 ELSE 100.0 END, CASE WHEN kind = 3 THEN 60.0 ELSE 100.0 END), 3) END AS overall FROM more),
audit AS (SELECT sample_id, task_name, CASE WHEN bad OR NOT passed OR effect THEN 'REJECT'
          WHEN said = 'UNSURE' THEN CASE WHEN tag0 = 'none' THEN 'ACCEPT' ELSE 'REJECT' END
          WHEN said = 'ACCEPT' AND tag0 NOT IN ('physical_infeasibility', 'missing_visual_evidence', 'wrong_step') THEN 'ACCEPT' ELSE 'REJECT' END AS decision, bad AS parse_error FROM more)
"""


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, conv_id, turn, task_name, question, answer): a user's turn and the assistant's next."""
    t = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)}).where("role = 'user'")
    answer = F.when(F.col("next_role") == "assistant", F.trim("next_text")).otherwise(F.lit(""))
    key = F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, v)])
    return rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sample_id"), "conv_id", "turn", key[(F.col("conv_id") % 20 + 1).cast("int")].alias("task_name"), F.trim("text").alias("question"), answer.alias("answer"))


_names = "[" + ", ".join(repr(NAMES[k]) for k in sorted(NAMES)) + "]"
QA = f"""
turns AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations),
qa AS (SELECT conv_id || '-' || turn AS sample_id, conv_id, turn, {_names}[(conv_id % 20 + 1)::INT] AS task_name, trim(text, ' ') AS question,
       CASE WHEN next_role = 'assistant' THEN trim(next_text, ' ') ELSE '' END AS answer FROM turns WHERE role = 'user')
"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, trace, answer): a document and the benchmark text that its id points at."""
    b = table(spark, sf_dir, "benchmark")
    n = b.count()
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("trace"))
    place = b.select(F.col("item_id"), F.col("text").alias("answer"))
    return d.withColumn("item_id", F.col("sample_id") % F.lit(n)).join(F.broadcast(place) if n <= 100_000 else place, "item_id").drop("item_id")


TRACES = """traces AS (SELECT doc_id AS sample_id, d.text AS trace, b.text AS answer FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step row, response): a step's own goal and its neighbours as gold, another step's words around them as response."""
    s = steps(spark, sf_dir)
    w = Window.partitionBy("item").orderBy("step_id")
    rows = s.select("item", "step_id", "step_goal", F.coalesce(F.lag("step_goal").over(w), F.lit("")).alias("prev_goal"), F.coalesce(F.lead("step_goal").over(w), F.lit("")).alias("next_goal"))
    kind = h("resp", F.concat_ws("-", "item", "step_id")) % 5
    response = (
        F.when(kind == 0, F.concat(F.lit("Step "), F.col("step_id").cast("string"), F.lit(" repeats "), F.col("step_goal")))
        .when(kind == 1, F.concat(F.lit("First lift and hold "), F.col("next_goal")))
        .when(kind == 2, F.concat_ws(" ", F.col("step_goal"), F.lit("then"), F.col("prev_goal")))
        .when(kind == 3, F.concat(F.lit("In step "), (F.col("step_id") + 1).cast("string"), F.lit(" the corrected plan is "), F.col("next_goal"), F.lit(" "), F.col("step_goal")))
        .otherwise(F.lit("Nothing of it"))
    )
    return rows.withColumn("response", response)


def _tokens(column: str) -> str:
    from quern.functions.text import REWARD_STOPWORDS, REWARD_TOKEN

    stop = ", ".join(repr(x) for x in REWARD_STOPWORDS)
    pattern = REWARD_TOKEN.replace("'", "''")
    return f"list_filter(list_distinct(regexp_extract_all(lower({column}), '{pattern}')), lambda t: length(t) > 1 AND NOT list_contains([{stop}], t))"


def sql_recall(pred: str, gold: str) -> str:
    return f"(CASE WHEN len({gold}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({pred}, {gold}))::DOUBLE / len({gold})::DOUBLE END)"


def sql_f1(a: str, b: str) -> str:
    p, r = sql_recall(b, a), sql_recall(a, b)
    return f"(CASE WHEN {p} + {r} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {p} * {r} / ({p} + {r}) END)"


REWARDS = f"""{STEPS},
near AS (SELECT item, step_id, step_goal, coalesce(lag(step_goal) OVER (PARTITION BY item ORDER BY step_id), '') AS prev_goal,
         coalesce(lead(step_goal) OVER (PARTITION BY item ORDER BY step_id), '') AS next_goal, {sql_h('resp', "item || '-' || step_id")} % 5 AS kind FROM steps),
said AS (SELECT *, CASE kind WHEN 0 THEN 'Step ' || step_id || ' repeats ' || step_goal WHEN 1 THEN 'First lift and hold ' || next_goal WHEN 2 THEN step_goal || ' then ' || prev_goal
         WHEN 3 THEN 'In step ' || (step_id + 1) || ' the corrected plan is ' || next_goal || ' ' || step_goal ELSE 'Nothing of it' END AS response FROM near),
rewards AS (SELECT *, {_tokens('response')} AS r, {_tokens('step_goal')} AS g, {_tokens('next_goal')} AS nx, {_tokens('prev_goal')} AS pv FROM said)
"""


def causal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, step_id, points_id): steps, and the part whose causal fields they have."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.row_number().over(order).cast("long").alias("step_id"), F.col("l_partkey").alias("points_id"))


def _said(*x: Column | str) -> Column:
    return F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])


def _points() -> list[Column]:
    """What the part says of a step: conditions before and after."""
    n, t, b = F.col("p_name"), F.lower("p_type"), F.lower("p_brand")
    return [
        F.array(_said("The ", n, " is on the table."), _said("The ", b, " tool is near the ", n, ".")).alias("sp_pre"),
        F.array(_said("The ", n, " can be moved freely."), F.when(F.col("p_size") % 5 == 0, F.lit("Not directly observable.")).otherwise(_said("The ", t, " surface is dry and clean."))).alias("af_pre"),
        F.array(_said("The ", n, " is inside the box."), _said("The ", b, " tool is far from the box.")).alias("sp_eff"),
        F.array(_said("The ", n, " cannot move any more."), _said("The ", t, " surface is covered.")).alias("af_eff"),
    ]


def _frame_fields() -> list[Column]:
    """Where the keyframe of a step stands, and by what it works."""
    return [(F.col("p_size") % 2 + 1).cast("int").alias("place"), _said("Friction holds the ", F.col("p_name"), ".").alias("mechanism")]


def causal_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(points_id, step_goal, sp_pre, af_pre, sp_eff, af_eff, place, mechanism): the causal fields of parts, once each."""
    return table(spark, sf_dir, "part").where("p_partkey is not null").select(F.col("p_partkey").alias("points_id"), F.col("p_name").alias("step_goal"), *_points(), *_frame_fields())


def causal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with causal fields made of part names: patients, actions, conditions before and after, keyframes."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    rows = line.withColumn("step_id", F.row_number().over(order).cast("long")).join(part, line.l_partkey == part.p_partkey)
    n, t = F.col("p_name"), F.lower("p_type")
    return rows.select(
        F.col("l_orderkey").alias("item"), "step_id", n.alias("step_goal"), n.alias("patient"),
        F.when(F.col("l_linenumber") % 2 == 0, _said("lift the ", n, " and place it")).otherwise(_said("turn ", n)).alias("action"),
        *_points(), *_frame_fields(),
        F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.replace(t, F.lit(" "), F.lit("_"))).alias("affordance"),
        F.when(F.col("p_size") % 3 == 0, F.lit("it turns.")).otherwise(_said("the ", n, " changes its place")).alias("change"),
    )


CAUSAL = """
causal AS (SELECT l_orderkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)::BIGINT AS step_id,
 p_name AS n, lower(p_type) AS t, lower(p_brand) AS b, p_size, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
