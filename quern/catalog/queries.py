"""The catalogue: one query for each operator of the survey, with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.catalog import sql as S
from quern.catalog import views as V
from quern.catalog.views import CAUSAL, JUDGE, JUDGE_FIVE, QA, REWARDS, SPANS, STEPS, TRACES, sql_f1, sql_h, sql_recall, table
from quern.functions import leak, morph, scoring, text
from quern.operators import audit, evaluate, qa, rank, resolve, resume, rewrite, trace
from quern.plans import generate, intervals, moments, schema, steps
from quern.plans.dims import NAMES
from quern.sources import media

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.judge(spark, sf_dir).withColumn("s", scoring.two_axis(F.col("raw")))
    return s.select("sample_id", "task_name", F.col("s.visual_grounding_score").alias("visual"), F.col("s.logical_coherence_score").alias("logical"), F.col("s.overall").alias("overall"), F.array_join("s.tags", ",").alias("tag"), F.col("s.parse_error").alias("parse_error"))


# --- judge scores, ranks, summaries ---


@query(f"WITH {JUDGE} SELECT sample_id, task_name, visual::DOUBLE AS visual, logical::DOUBLE AS logical, overall::DOUBLE AS overall, tag, parse_error FROM scored")
def q_score_two_axis(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(f"WITH {JUDGE_FIVE} SELECT sample_id, task_name, overall::DOUBLE AS overall, tags, parse_error FROM five")
def q_score_five_axis(spark, sf_dir):
    s = V.judge_five(spark, sf_dir).withColumn("s", scoring.five_axis(F.col("raw")))
    return s.select("sample_id", "task_name", F.col("s.overall").alias("overall"), F.array_join("s.tags", ",").alias("tags"), F.col("s.parse_error").alias("parse_error"))


def _audited(spark, sf_dir):
    return V.judge_five(spark, sf_dir).withColumn("s", scoring.binary_audit(F.col("raw"))).select("sample_id", "task_name", F.col("s.decision").alias("decision"), F.col("s.parse_error").alias("parse_error"))


@query(f"WITH {JUDGE_FIVE} SELECT sample_id, task_name, decision, parse_error FROM audit")
def q_binary_audit(spark, sf_dir):
    return _audited(spark, sf_dir)


_RANKED = """ranked AS (SELECT sample_id, task_name, visual, logical, overall, row_number() OVER (ORDER BY overall DESC, task_name, sample_id) AS rank FROM scored),
kept AS (SELECT greatest(1, round_even(count(*) * 0.5::DOUBLE, 0))::BIGINT AS k FROM scored)"""


@query(f"WITH {JUDGE}, {_RANKED} SELECT sample_id, task_name, overall::DOUBLE AS overall, rank, rank <= (SELECT k FROM kept) AS accepted FROM ranked")
def q_rank_top_fraction(spark, sf_dir):
    return rank.top_fraction(_scored(spark, sf_dir).select("sample_id", "task_name", "overall"))


@query(f"WITH {JUDGE}, {_RANKED} SELECT sample_id, rank, rank <= (SELECT k FROM kept) AND overall >= 75 AND least(visual, logical) >= 50 AS accepted FROM ranked")
def q_rank_threshold(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("axes", F.array("visual", "logical"))
    return rank.over_thresholds(rank.top_fraction(rows)).select("sample_id", "rank", "accepted")


@query(f"""WITH {JUDGE} SELECT CASE WHEN overall < 25 THEN '0-24' WHEN overall < 50 THEN '25-49' WHEN overall < 75 THEN '50-74' WHEN overall < 90 THEN '75-89' ELSE '90-100' END AS band,
count(*) AS n FROM scored GROUP BY 1""")
def q_score_bands(spark, sf_dir):
    return evaluate.score_bands(_scored(spark, sf_dir))


@query(f"""WITH {JUDGE_FIVE} SELECT task_name, count(*) FILTER (WHERE decision = 'ACCEPT') AS "ACCEPT", count(*) FILTER (WHERE decision = 'REJECT') AS "REJECT" FROM audit GROUP BY task_name""")
def q_decision_pivot(spark, sf_dir):
    return evaluate.decision_matrix(_audited(spark, sf_dir))


def _open(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("task_name"))
    n = V.h("open", "sample_id")
    shown = F.when(n % 9 == 0, F.lit("true")).when(n % 9 == 1, F.lit("1.2")).when(n % 9 == 2, F.concat(F.lit('"0.'), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit('"'))).otherwise(F.concat(F.lit("0."), F.lpad((n % 1000).cast("string"), 3, "0")))
    return d.select("sample_id", "task_name", scoring.open_score(F.concat(F.lit('{"score": '), shown, F.lit("}"))).alias("score"))


_OPEN = f"""
open AS (SELECT doc_id AS sample_id, lang AS task_name, CASE WHEN {sql_h('open', 'doc_id')} % 9 < 2 THEN NULL ELSE ({sql_h('open', 'doc_id')} % 1000) / 1000.0::DOUBLE END AS score FROM documents),
summary AS (SELECT task_name, count(*) AS total, count(score) AS valid, count(*) - count(score) AS parse_errors, count(*) FILTER (WHERE score < 0.25) AS band_0,
  count(*) FILTER (WHERE score >= 0.25 AND score < 0.5) AS band_1, count(*) FILTER (WHERE score >= 0.5 AND score < 0.75) AS band_2, count(*) FILTER (WHERE score >= 0.75) AS band_3,
  round(coalesce(sum(score), 0) / count(*), 4) AS average, CASE WHEN count(score) > 0 THEN round(sum(score) / count(score), 4) ELSE 0.0 END AS average_valid FROM open GROUP BY task_name)
"""


@query(f"WITH {_OPEN} SELECT * FROM summary")
def q_openqa_summary(spark, sf_dir):
    return evaluate.open_summary(_open(spark, sf_dir), "task_name")


@query(f"WITH {_OPEN} SELECT sum(total)::BIGINT AS total, sum(valid)::BIGINT AS valid, round(sum(average * total) / sum(total), 4) AS average, round(sum(average_valid * valid) / sum(valid), 4) AS average_valid FROM summary")
def q_openqa_overall(spark, sf_dir):
    return evaluate.open_overall(evaluate.open_summary(_open(spark, sf_dir), "task_name"))


def _mcq(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("task_name"))
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (V.h("letter", "sample_id") % 4 + 1).cast("int"))
    gold = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (V.h("gold", "sample_id") % 4 + 1).cast("int"))
    kind = V.h("form", "sample_id") % 9
    forms = [F.concat(F.lit('{"answer": "'), letter, F.lit('"}')), F.concat(F.lit('```json\n{"answer": "'), letter, F.lit('"}\n```')), F.concat(F.lit("Final answer: "), letter), F.concat(F.lit("I choose option "), F.lower(letter)),
             F.concat(F.lit("so it is</think> "), letter), letter, F.concat(F.lit("Much is said before it ends with ("), letter, F.lit(")")), F.lit(""), F.lit("nothing that helps")]
    response = F.element_at(F.array(*forms), (kind + 1).cast("int"))
    return d.select("sample_id", "task_name", gold.alias("gold"), evaluate.mcq_letter(response).alias("predicted"))


_MCQ = f"""
mcq AS (SELECT doc_id AS sample_id, lang AS task_name, ['A','B','C','D'][({sql_h('gold', 'doc_id')} % 4 + 1)::INT] AS gold,
  CASE WHEN {sql_h('form', 'doc_id')} % 9 >= 7 THEN NULL ELSE ['A','B','C','D'][({sql_h('letter', 'doc_id')} % 4 + 1)::INT] END AS predicted FROM documents),
summary AS (SELECT task_name, count(*) AS total, count(predicted) AS answered, count(*) FILTER (WHERE predicted = gold) AS correct, count(*) - count(predicted) AS failed_to_parse,
  round(count(*) FILTER (WHERE predicted = gold) / count(*)::DOUBLE, 4) AS accuracy, round(count(*) FILTER (WHERE predicted = gold) / nullif(count(predicted), 0)::DOUBLE, 4) AS accuracy_on_answered FROM mcq GROUP BY task_name)
"""


@query(f"WITH {_MCQ} SELECT sample_id, gold, predicted FROM mcq")
def q_mcq_letter(spark, sf_dir):
    return _mcq(spark, sf_dir).select("sample_id", "gold", "predicted")


@query(f"WITH {_MCQ} SELECT * FROM summary")
def q_mcq_summary(spark, sf_dir):
    return evaluate.mcq_summary(_mcq(spark, sf_dir), "task_name")


@query(f"WITH {_MCQ} SELECT sum(total)::BIGINT AS total, sum(answered)::BIGINT AS answered, sum(correct)::BIGINT AS correct, sum(failed_to_parse)::BIGINT AS failed_to_parse, round(sum(correct) / sum(total)::DOUBLE, 4) AS accuracy, round(sum(correct) / sum(answered)::DOUBLE, 4) AS accuracy_on_answered FROM summary")
def q_mcq_overall(spark, sf_dir):
    return evaluate.mcq_overall(evaluate.mcq_summary(_mcq(spark, sf_dir), "task_name"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def q_dup_ids(spark, sf_dir):
    return evaluate.duplicate_ids(table(spark, sf_dir, "events"), "user_id")


@query("""WITH u AS (SELECT event_type AS stage, 'model_' || chr((97 + event_id % 5)::INT) AS model, (event_id % 1000)::BIGINT AS i, (user_id % 700)::BIGINT AS o FROM events),
c AS (SELECT *, i / 1000.0::DOUBLE * CASE model WHEN 'model_a' THEN 0.0032 WHEN 'model_b' THEN 0.0006 WHEN 'model_c' THEN 0.0008 ELSE 0 END
 + o / 1000.0::DOUBLE * CASE model WHEN 'model_a' THEN 0.016 WHEN 'model_b' THEN 0.0036 WHEN 'model_c' THEN 0.002 ELSE 0 END AS cost FROM u)
SELECT stage, model, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, round(sum(cost), 6) AS cost FROM c GROUP BY ROLLUP (stage, model)""")
def q_token_cost(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.concat(F.lit("model_"), F.char(F.lit(97) + F.col("event_id") % 5)).alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("user_id") % 700).alias("tokens_out"))
    return evaluate.token_cost(e)


@query(f"WITH {QA} SELECT count(*) AS total, count(nullif(answer, '')) AS filled, count(*) - count(nullif(answer, '')) AS missing, round(count(nullif(answer, '')) / count(*)::DOUBLE, 4) AS fill_rate, count(*) - count(nullif(answer, '')) > count(*) * 0.05 AS failed FROM qa")
def q_fill_rate(spark, sf_dir):
    return evaluate.fill_rate(V.qa(spark, sf_dir).withColumn("answer", F.nullif("answer", F.lit(""))), "answer")


# --- question rows ---


@query(f"WITH {QA} SELECT sample_id, conv_id, turn, task_name, question, answer FROM qa")
def q_qa_pairs(spark, sf_dir):
    return V.qa(spark, sf_dir)


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), F.trim(x["text"]).alias("text"))).alias("turns"))


@query("""SELECT conv_id, coalesce(trim(arg_min(text, turn) FILTER (WHERE role = 'user' AND trim(text, ' ') <> ''), ' '), '') AS question,
coalesce(trim(arg_max(text, turn) FILTER (WHERE role = 'assistant' AND trim(text, ' ') <> ''), ' '), '') AS answer FROM conversations GROUP BY conv_id""")
def q_first_last_turn(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", qa.first_question(F.col("turns")).alias("question"), qa.last_answer(F.col("turns")).alias("answer"))


@query(f"""WITH {QA}, f AS (SELECT *, CASE conv_id % 4 WHEN 0 THEN 'keyframe_single' WHEN 1 THEN 'video_clip' WHEN 2 THEN 'unknown' ELSE 'video_prefix' END AS e, conv_id % 3 AS ni, conv_id % 2 AS nv FROM qa)
SELECT sample_id, concat_ws(',', CASE WHEN question = '' THEN 'missing_question' END, CASE WHEN answer = '' THEN 'missing_answer' END, CASE WHEN e = 'unknown' THEN 'missing_evidence_type' END,
CASE WHEN e = 'keyframe_single' AND ni = 0 THEN 'missing_image_evidence' END, CASE WHEN e IN ('video_clip', 'video_prefix') AND nv = 0 THEN 'missing_video_evidence' END) AS issues FROM f""")
def q_preflight_issues(spark, sf_dir):
    rows = V.qa(spark, sf_dir)
    evidence = F.element_at(F.array(*[F.lit(x) for x in ("keyframe_single", "video_clip", "unknown", "video_prefix")]), (F.col("conv_id") % 4 + 1).cast("int"))
    images, videos = F.array_repeat(F.lit("i.jpg"), (F.col("conv_id") % 3).cast("int")), F.array_repeat(F.lit("v.mp4"), (F.col("conv_id") % 2).cast("int"))
    return rows.select("sample_id", F.array_join(qa.preflight(F.col("question"), F.col("answer"), evidence, images, videos), ",").alias("issues"))


@query("""WITH m AS (SELECT conv_id, turn, role, trim(text, ' ') AS t FROM conversations WHERE trim(text, ' ') <> ''),
g AS (SELECT conv_id, string_agg(role || ': ' || t, chr(10) ORDER BY turn) AS body, bool_or(role = 'system') AS sys, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a FROM m GROUP BY conv_id)
SELECT conv_id, CASE WHEN sys THEN '' ELSE 'system: Be brief.' || chr(10) END || body AS messages, u AND a AS valid FROM g""")
def q_sft_messages(spark, sf_dir):
    m = _turns(spark, sf_dir).select("conv_id", qa.sft_messages(F.col("turns"), "Be brief.").alias("m"))
    return m.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat_ws(": ", x["role"], x["content"])), "\n").alias("messages"), qa.valid_sft(F.col("m"), True).alias("valid"))


@query(f"""WITH {QA}, n AS (SELECT sample_id, question, (conv_id % 3)::INT AS i, (conv_id % 2)::INT AS v, (length(question) - length(replace(question, '<image>', ''))) // 7 AS ti, (length(question) - length(replace(question, '<video>', ''))) // 7 AS tv FROM qa)
SELECT sample_id, CASE WHEN i <= ti AND v <= tv THEN question ELSE trim(repeat('<image>', greatest(0, i - ti)::BIGINT) || repeat('<video>', greatest(0, v - tv)::BIGINT) || chr(10) || question, ' ') END AS content FROM n""")
def q_media_tags(spark, sf_dir):
    rows = V.qa(spark, sf_dir)
    return rows.select("sample_id", qa.with_tags(F.col("question"), (F.col("conv_id") % 3).cast("int"), (F.col("conv_id") % 2).cast("int")).alias("content"))


@query("SELECT p_partkey AS row_id, 'A. ' || p_name || chr(10) || 'C. ' || p_brand || chr(10) || 'D. ' || p_type AS options FROM part")
def q_options_lettered(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("row_id"), qa.lettered(F.array("p_name", F.lit(" "), "p_brand", "p_type")).alias("options"))


@query(f"""WITH {QA} SELECT sample_id, sha1('pack' || chr(10) || substr(task_name, 1, 7) || chr(10) || chr(10) || chr(10) || sample_id) AS uid, '<video>' || chr(10) || question AS prompt, 'file:///v/' || sample_id || '.mp4' AS video_uri,
substr(task_name, 1, 7) AS task_id, concat_ws(',', CASE WHEN question = '' THEN 'extra_info.question is missing' END, CASE WHEN answer = '' THEN 'extra_info.reference_answer is missing' END) AS errors FROM qa""")
def q_rl_rows(spark, sf_dir):
    rows = V.qa(spark, sf_dir).withColumn("video", F.concat(F.lit("/v/"), F.col("sample_id"), F.lit(".mp4")))
    built = rows.select("sample_id", *qa.rl_row("sample_id", "task_name", "question", "answer", "video", "pack"))
    return built.select("sample_id", "uid", F.col("prompt")[0]["content"].alias("prompt"), F.col("videos")[0]["video"].alias("video_uri"), "extra_info.task_id", F.array_join(qa.rl_errors(), ",").alias("errors"))


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN '/w/' || substr(url, 13) WHEN starts_with(url, 'https://') THEN '/s/' || substr(url, 9) WHEN starts_with(url, 'http') THEN '/h/' || substr(url, 5) ELSE url END AS path FROM pages""")
def q_path_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", qa.rewritten(F.col("url"), {"http": "/h/", "https://": "/s/", "https://www.": "/w/"}).alias("path"))


# --- text ---


@query(f"WITH {REWARDS} SELECT item, step_id, round({sql_recall('r', 'g')}, 6) AS recall, round({sql_recall('g', 'r')}, 6) AS precision, round({sql_f1('r', 'g')}, 6) AS f1 FROM rewards")
def q_token_prf(spark, sf_dir):
    rows = V.rewards(spark, sf_dir).select("item", "step_id", text.reward_tokens(F.col("response")).alias("r"), text.reward_tokens(F.col("step_goal")).alias("g"))
    r, g = F.col("r"), F.col("g")
    return rows.select("item", "step_id", F.round(text.token_recall(r, g), 6).alias("recall"), F.round(text.token_recall(g, r), 6).alias("precision"), F.round(text.token_f1(r, g), 6).alias("f1"))


@query(f"""WITH {REWARDS} SELECT item, step_id, round(0.7::DOUBLE * ({sql_recall('r', 'g')} + {sql_recall('r', 'nx')}) / 2 + 0.2::DOUBLE * {sql_f1('r', 'g')}
+ 0.1::DOUBLE * CASE WHEN prev_goal <> '' AND {sql_recall('r', 'pv')} > 0 THEN 1 ELSE 0 END, 6) AS reward FROM rewards""")
def q_fact_reward(spark, sf_dir):
    rows = V.rewards(spark, sf_dir)
    return rows.select("item", "step_id", F.round(scoring.fact_reward(F.col("response"), F.array("step_goal", "next_goal"), F.col("step_goal"), F.col("prev_goal")), 6).alias("reward"))


_REPAIR = f"""parts AS (SELECT item, step_id, response, {sql_recall('r', 'nx')} AS cover, {sql_recall('r', 'g')} AS copied,
 CASE kind WHEN 0 THEN 1.0 WHEN 3 THEN CASE WHEN step_id = 0 THEN 0.0 ELSE 0.5 END ELSE 0.0 END AS named, CASE WHEN kind = 0 THEN 1.0 ELSE {sql_f1('r', "['redundant', 'step']")} END AS flawed, kind FROM rewards)"""


@query(f"""WITH {REWARDS}, {_REPAIR} SELECT item, step_id, round(0.15::DOUBLE * named + 0.2::DOUBLE * flawed + 0.5::DOUBLE * cover + 0.15::DOUBLE * CASE WHEN copied > 0.65 AND cover < 0.45 THEN 0.25
WHEN copied > 0.75 AND kind <> 3 THEN 0.55 ELSE 1.0 END, 6) AS reward FROM parts""")
def q_repair_reward(spark, sf_dir):
    rows = V.rewards(spark, sf_dir)
    return rows.select("item", "step_id", F.round(scoring.repair_reward(F.col("response"), F.col("step_id"), F.lit("redundant_step"), F.array("step_goal"), F.array("next_goal")), 6).alias("reward"))


_RECOVERY = f"""acts AS (SELECT item, step_id, r, {sql_recall('r', 'nx')} AS cover, {sql_recall('r', 'g')} AS parrot, {sql_recall('r', 'pv')} AS goal, len(list_intersect(r, [{', '.join(repr(x) for x in scoring.ACTION_TERMS)}])) > 0 AS hit,
 CASE WHEN len(r) = 0 THEN 0.0 ELSE len(list_filter(r, lambda t: NOT list_contains(g, t)))::DOUBLE / len(r) END AS fresh FROM rewards),
whole AS (SELECT *, 0.45::DOUBLE * cover + 0.2::DOUBLE * least(1.0::DOUBLE, 0.45::DOUBLE * CASE WHEN hit THEN 1 ELSE 0 END + 0.55::DOUBLE * greatest(cover, goal)) + 0.2::DOUBLE * fresh
 + 0.15::DOUBLE * CASE WHEN cover >= 0.35 AND parrot > 0 THEN 1.0 ELSE cover END AS raw FROM acts)"""
_RECOVERED = "least(raw, CASE WHEN parrot >= 0.45 AND cover < 0.25 THEN 0.30 WHEN parrot >= 0.65 AND cover < 0.45 THEN 0.55 ELSE 1.0 END::DOUBLE)"


def _recovery():
    return scoring.recovery_reward(F.col("response"), F.col("step_goal"), F.col("next_goal"), F.col("prev_goal"))


@query(f"WITH {REWARDS}, {_RECOVERY} SELECT item, step_id, round({_RECOVERED}, 6) AS reward FROM whole")
def q_recovery_reward(spark, sf_dir):
    return V.rewards(spark, sf_dir).select("item", "step_id", F.round(_recovery(), 6).alias("reward"))


@query(f"""WITH {REWARDS}, {_RECOVERY}, b AS (SELECT item, step_id, {_RECOVERED} AS rule, ({sql_h('judge', "item || '-' || step_id")} % 1200 - 200) / 1000.0::DOUBLE AS judge, CASE item % 3 WHEN 0 THEN 0.15 WHEN 1 THEN 0.25 ELSE 0.0 END::DOUBLE AS alpha FROM whole)
SELECT item, step_id, round(CASE WHEN judge < 0 THEN -1.0::DOUBLE ELSE greatest(0, least(1, alpha * rule + (1 - alpha) * judge)) END, 6) AS score FROM b""")
def q_blend(spark, sf_dir):
    judge = (V.h("judge", F.concat_ws("-", "item", "step_id")) % 1200 - 200) / F.lit(1000.0)
    task = F.element_at(F.array(F.lit("Task_01"), F.lit("Task_18"), F.lit("Task_06")), (F.col("item") % 3 + 1).cast("int"))
    return V.rewards(spark, sf_dir).select("item", "step_id", F.round(scoring.blended(task, _recovery(), judge), 6).alias("score"))


@query(f"""WITH a AS (SELECT doc_id, list_transform(range(1, 6), lambda i: {sql_h("' || i || '", 'doc_id')} % 3) AS v, list_transform(range(1, 6), lambda i: {sql_h("d' || i || '", 'doc_id')} % 9 = 0) AS d, {sql_h('ok', 'doc_id')} % 11 AS k FROM labels),
b AS (SELECT *, list_sum(list_transform(v, lambda x: x / 2.0::DOUBLE)) / 5 AS mean, list_min(list_transform(range(1, 6), lambda i: CASE WHEN d[i] THEN [0.35, 0.6, 0.25, 0.5, 0.45][i] ELSE 1.0 END)) AS cap FROM a)
SELECT doc_id, CASE WHEN k = 0 THEN 'invalid_judge_input' WHEN k = 1 THEN 'missing_answers' WHEN k = 2 THEN 'missing_evidence' ELSE 'ok' END AS status, round(CASE WHEN k = 0 THEN -1.0 WHEN k < 3 THEN NULL ELSE least(mean, cap) END, 6)::DOUBLE AS score FROM b""")
def q_rubric(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (V.h("ok", "doc_id") % 11).alias("k"))
    word = F.array(F.lit("no"), F.lit("PARTIALLY"), F.lit("Yes "))
    pairs = lambda name, value: F.map_from_arrays(F.array(*[F.lit(f"{name}{i}") for i in range(1, 6)]), F.array(*[value(i) for i in range(1, 6)]))
    answers = pairs("q", lambda i: F.element_at(word, (V.h(str(i), "doc_id") % 3 + 1).cast("int")))
    marks = pairs("d", lambda i: F.when(V.h(f"d{i}", "doc_id") % 9 == 0, "yes").otherwise("no"))
    evidence = pairs("q", lambda i: F.when((F.col("k") == 2) & F.lit(i == 3), " ").otherwise("seen"))
    answers = F.when(F.col("k") == 1, F.map_filter(answers, lambda k, v: k != "q4")).otherwise(answers)
    s = rows.withColumn("s", scoring.rubric_score(F.lit("Task_01"), answers, marks, evidence, F.col("k") != 0))
    return s.select("doc_id", "s.status", F.round("s.score", 6).alias("score"))


_GRAMS = lambda w, n=4: f"(CASE WHEN len({w}) >= {n} THEN list_distinct(list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))) ELSE [] END)"


@query(f"""WITH {TRACES}, w AS (SELECT sample_id, regexp_extract_all(lower(trace), '\\S+') AS t, regexp_extract_all(lower(answer), '\\S+') AS a FROM traces), g AS (SELECT sample_id, {_GRAMS('t')} AS t, {_GRAMS('a')} AS a FROM w)
SELECT sample_id, round(CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - len(list_intersect(t, a))::DOUBLE / len(t)::DOUBLE END, 6) AS novelty FROM g""")
def q_ngram_novelty(spark, sf_dir):
    return V.traces(spark, sf_dir).select("sample_id", F.round(text.novelty(F.col("trace"), F.col("answer")), 6).alias("novelty"))


@query(f"""WITH {TRACES}, w AS (SELECT sample_id, regexp_extract_all(lower(trace), '\\S+') AS t FROM traces), s AS (SELECT sample_id, len(t) AS n, t[1:(len(t) // 2)] AS p, t[(len(t) // 2 + 1):] AS q FROM w),
g AS (SELECT sample_id, n, {_GRAMS('p')} AS p, {_GRAMS('q')} AS q FROM s) SELECT sample_id, round(CASE WHEN n < 20 OR len(q) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(p, q))::DOUBLE / len(q)::DOUBLE END, 6) AS repetition FROM g""")
def q_half_repetition(spark, sf_dir):
    return V.traces(spark, sf_dir).select("sample_id", F.round(text.half_repetition(F.col("trace")), 6).alias("repetition"))


@query(S.SENTENCE_REPETITION)
def q_sentence_repetition(spark, sf_dir):
    r = resolve.sentence_repetition(table(spark, sf_dir, "documents"), "doc_id", "text")
    return r.select("doc_id", F.round("repetition", 6).alias("repetition"))


_WORDS = ["the", "and", "of", "for", "que", "der", "die", "les"]


@query(f"""WITH {TRACES}, w AS (SELECT sample_id, list_transform(regexp_extract_all(lower(trace), '\\S+'), lambda x: trim(x, '.,;:!?()[]')) AS t FROM traces)
SELECT sample_id, round(CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_filter(t, lambda x: list_contains([{', '.join(repr(x) for x in _WORDS)}], x)))::DOUBLE / len(t)::DOUBLE END, 6) AS density FROM w""")
def q_indicator_density(spark, sf_dir):
    return V.traces(spark, sf_dir).select("sample_id", F.round(text.indicator_density(F.col("trace"), _WORDS), 6).alias("density"))


@query(S.TAIL_OVERLAP)
def q_tail_overlap(spark, sf_dir):
    return V.traces(spark, sf_dir).select("sample_id", F.round(trace.tail_overlap(F.col("trace"), F.col("answer")), 6).alias("overlap"))


@query(S.trace_validate(_WORDS))
def q_trace_validate(spark, sf_dir):
    task = F.element_at(F.array(*[F.lit(f"Task_{i:02d}") for i in range(1, 21)]), (F.col("sample_id") % 20 + 1).cast("int"))
    return V.traces(spark, sf_dir).select("sample_id", trace.first_failure(F.col("trace"), F.col("answer"), task, _WORDS).alias("reason"))


_LEAK = "|".join(f"(?:{p.replace('(?i)', '')})" for p in leak.LEAK_PATTERNS)


@query(f"SELECT page_id, regexp_matches(url || ' ' || html, '(?i)' || '{_LEAK}') AS leaks, regexp_matches(html, '{leak.TIME_REFERENCE}') AS times FROM pages")
def q_frame_leak(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", leak.has_leak(F.concat_ws(" ", "url", "html")).alias("leaks"), leak.has_time_reference(F.col("html")).alias("times"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b'))), ',') AS tokens FROM pages""")
def q_snake_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(text.snake_tokens(F.col("html"))), ",").alias("tokens"))


@query("""SELECT page_id, array_to_string(regexp_extract_all(html, '"([^"]+)"', 1), '|') AS spans FROM pages""")
def q_quotes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.quoted(F.col("html")), "|").alias("spans"))


@query(r"""WITH b AS (SELECT doc_id, trim(text, ' ') AS raw, list_filter(list_transform(string_split(trim(text, ' '), chr(10)), lambda x: trim(regexp_replace(trim(regexp_replace(x, '^\s*[-*•]\s*', ''), ' '), '^\s*[0-9]+\s*[.)、]\s*', ''), ' ')), lambda x: x <> '') AS k FROM documents)
SELECT doc_id, len(k)::INT AS points, k[1] AS first FROM b""")
def q_numbered_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.numbered_points(F.col("text")).alias("p"))
    return d.select("doc_id", F.size("p").alias("points"), F.get("p", F.lit(0)).alias("first"))


@query(S.HEADING_STRIP)
def q_heading_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.stripped_headings(F.col("text"))).alias("text_md5"))


_STOP = ", ".join(repr(x) for x in text.TERM_STOPWORDS)
_TERMS = lambda c: f"list_filter(list_distinct(regexp_extract_all(replace(lower({c}), '-', ' '), '[a-z0-9_]+')), lambda t: length(t) >= 3 AND NOT list_contains([{_STOP}], t))"


@query(f"SELECT p_partkey, array_to_string(list_sort({_TERMS('p_name')}), ' ') AS terms FROM part")
def q_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(text.terms(F.col("p_name"))), " ").alias("terms"))


@query(S.SPAN_RELAXED)
def q_span_relaxed(spark, sf_dir):
    rows = V.rewards(spark, sf_dir)
    return rows.select("item", "step_id", text.span_present(F.col("step_goal"), F.col("response")).alias("present"))


@query("SELECT p_partkey, ('0x' || substr(md5('t:' || p_partkey || ':' || p_name), 1, 12))::BIGINT % 7 AS pick FROM part")
def q_template_pick(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.template_pick(7, F.lit("t"), F.col("p_partkey"), F.col("p_name")).alias("pick"))


@query("""WITH o AS (SELECT DISTINCT p_brand, unnest([lower(p_name), lower(split_part(p_name, ' ', 1))]) AS object FROM part)
SELECT p_brand, object FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.p_brand = a.p_brand AND length(b.object) > length(a.object) AND contains(' ' || b.object || ' ', ' ' || a.object || ' '))""")
def q_subset_objects(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.explode(F.array(F.lower("p_name"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))))).alias("object"))
    return resolve.longest_names(p, "p_brand", "object")


@query(f"WITH {STEPS} SELECT item, array_to_string(list_transform(list_sort(list({{'s': m, 'g': step_goal}})), lambda x: x.g), '|') AS goals FROM (SELECT item, step_goal, min(step_id) AS m FROM steps GROUP BY item, step_goal) GROUP BY item")
def q_dedupe_keep_first(spark, sf_dir):
    s = V.steps(spark, sf_dir).groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_id", "step_goal"))), lambda x: x["step_goal"]).alias("g"))
    return s.select("item", F.array_join(F.array_distinct("g"), "|").alias("goals"))


@query(S.KEEP_FIRST)
def q_keep_first_sentences(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), F.array_join(text.keep_first(text.sentences(F.col("text"), 0)), " ").alias("kept"))


# --- steps ---


@query(f"WITH {STEPS} SELECT item, step_id, step_goal, lag(step_goal) OVER w AS prev_goal, lead(step_goal) OVER w AS next_goal FROM steps WINDOW w AS (PARTITION BY item ORDER BY step_id)")
def q_prev_next(spark, sf_dir):
    return steps.neighbours(V.steps(spark, sf_dir)).select("item", "step_id", "step_goal", "prev_goal", "next_goal")


@query(f"WITH {STEPS} SELECT * FROM (SELECT item, step_id, step_goal, lead(step_id) OVER w AS next_id, lead(step_goal) OVER w AS next_goal FROM steps WINDOW w AS (PARTITION BY item ORDER BY step_id)) WHERE next_id IS NOT NULL")
def q_next_step(spark, sf_dir):
    return steps.next_pairs(V.steps(spark, sf_dir))


_NEXT_K = f"""{STEPS}, n AS (SELECT *, count(*) OVER (PARTITION BY item) AS n FROM steps), k AS (SELECT *, least(greatest(3, least(6, n - step_id)), n - step_id)::INT AS k FROM n WHERE n >= 4 AND step_id < n),
nk AS (SELECT a.item, a.step_id, a.k, string_agg(b.step_goal, ' | ' ORDER BY b.step_id) AS next_goals FROM k a JOIN steps b ON b.item = a.item AND b.step_id > a.step_id AND b.step_id <= a.step_id + a.k GROUP BY ALL)"""


@query(f"WITH {_NEXT_K} SELECT * FROM nk")
def q_next_k(spark, sf_dir):
    return steps.next_k(V.steps(spark, sf_dir))


_MIDDLE = f"""{STEPS}, n AS (SELECT *, count(*) OVER (PARTITION BY item) AS n FROM steps),
mid AS (SELECT item, count(*) AS n_middle, string_agg(step_goal, ' | ' ORDER BY step_id) AS middle_goals FROM n WHERE step_id > 1 AND step_id < n AND step_id <= 9 GROUP BY item)"""


@query(f"WITH {_MIDDLE} SELECT * FROM mid")
def q_middle_steps(spark, sf_dir):
    return steps.middle_steps(V.steps(spark, sf_dir))


@query(f"WITH {STEPS} SELECT item, step_id, string_agg(step_id::VARCHAR, ',') OVER (PARTITION BY item ORDER BY step_id) AS prefix FROM steps")
def q_prefix(spark, sf_dir):
    return steps.prefixes(V.steps(spark, sf_dir))


@query(f"""WITH {STEPS}, g AS (SELECT step_goal AS goal, min(item) AS first_item FROM steps GROUP BY step_goal) SELECT goal, first_item, row_number() OVER (ORDER BY md5('42:' || goal), goal) AS place FROM g""")
def q_goal_pool(spark, sf_dir):
    return steps.goal_pool(V.steps(spark, sf_dir))


# --- intervals ---


@query(f"""WITH {SPANS}, p AS (SELECT *, lag("end") OVER (PARTITION BY item ORDER BY step_id) AS prev_end FROM spans)
SELECT item, step_id, "start", "end", prev_end, CASE WHEN prev_end IS NULL THEN 'first' WHEN "start" > prev_end THEN 'gap' WHEN "start" < prev_end THEN 'overlap' ELSE 'ok' END AS state FROM p""")
def q_interval_contiguity(spark, sf_dir):
    return intervals.contiguity(V.spans(spark, sf_dir).select("item", "step_id", "start", "end"))


@query(f"""WITH {SPANS}, p AS (SELECT *, lag("end") OVER (PARTITION BY item ORDER BY step_id) AS b FROM spans)
SELECT item, concat_ws(',', CASE WHEN min("start") <> 1 THEN 'start' END, CASE WHEN max("end") <> any_value(num_frames) + 1 THEN 'end' END, CASE WHEN count(*) FILTER (WHERE "start" <> b) > 0 THEN 'breaks' END,
CASE WHEN count(*) FILTER (WHERE "end" - "start" < 2) > 0 THEN 'short' END, CASE WHEN count(*) FILTER (WHERE "end" - "start" > num_frames * 0.6) > 0 AND count(*) > 1 THEN 'long' END) AS errors FROM p GROUP BY item""")
def q_localization_valid(spark, sf_dir):
    s = V.spans(spark, sf_dir)
    return intervals.localization_errors(s.select("item", "step_id", "start", "end"), s.select("item", "num_frames").distinct())


def _frames(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    f = e.select(F.col("user_id").alias("item"), F.unix_micros("ts").alias("us"), "event_id")
    return f.select("item", F.row_number().over(Window.partitionBy("item").orderBy("us", "event_id")).cast("long").alias("frame_index"), (F.col("us") / F.lit(1e6) - F.lit(1.7e9)).alias("ts"))


_FRAMES = "frames AS (SELECT user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS frame_index, epoch_us(ts) / 1e6::DOUBLE - 1.7e9::DOUBLE AS ts FROM events)"


@query(f"""WITH {_FRAMES}, d AS (SELECT item, lead(ts) OVER (PARTITION BY item ORDER BY ts) - ts AS d FROM (SELECT DISTINCT item, ts FROM frames)) SELECT item, round(coalesce(greatest(0.05, min(d) FILTER (WHERE d > 0)), 0.1), 3)::DOUBLE AS delta FROM d GROUP BY item""")
def q_min_delta(spark, sf_dir):
    return intervals.smallest_step(_frames(spark, sf_dir)).select("item", F.round("delta", 3).alias("delta"))


@query(f"""WITH {_FRAMES}, n AS (SELECT item, max(frame_index) AS n, max(ts) AS last_ts FROM frames GROUP BY item), d AS (SELECT item, lead(ts) OVER (PARTITION BY item ORDER BY ts) - ts AS d FROM (SELECT DISTINCT item, ts FROM frames)),
m AS (SELECT item, greatest(0.05, min(d) FILTER (WHERE d > 0)) AS delta FROM d GROUP BY item), s AS (SELECT item, unnest([[1, n // 3 + 1], [2, n // 2 + 1], [3, n + 1]]) AS x, n, last_ts FROM n)
SELECT s.item, s.x[1]::BIGINT AS step_id, round(CASE WHEN s.x[2] > s.n THEN s.last_ts + m.delta ELSE (a.ts + b.ts) / 2 END, 3) AS end_sec FROM s JOIN m ON m.item = s.item LEFT JOIN frames a ON a.item = s.item AND a.frame_index = s.x[2] LEFT JOIN frames b ON b.item = s.item AND b.frame_index = s.x[2] - 1""")
def q_end_sec(spark, sf_dir):
    f = _frames(spark, sf_dir)
    n = f.groupBy("item").agg(F.max("frame_index").alias("n"))
    ends = F.array(F.floor(F.col("n") / 3) + 1, F.floor(F.col("n") / 2) + 1, F.col("n") + 1)
    s = n.select("item", F.posexplode(ends).alias("p", "end")).select("item", (F.col("p") + 1).cast("long").alias("step_id"), F.col("end").cast("long").alias("end"))
    return intervals.end_seconds(s, f).select("item", "step_id", F.round("end_sec", 3).alias("end_sec"))


@query(f"""WITH {SPANS}, a AS (SELECT item AS i, step_id, "start" AS s, "end" AS e, "start" + ("end" - "start") // 2 AS m, item % 5 AS k FROM spans)
SELECT i AS item, step_id, concat_ws(',', CASE WHEN k = 0 THEN 'count' END, CASE WHEN k = 1 THEN 'ids' END, CASE WHEN k = 2 THEN 'breaks' END) AS errors FROM a""")
def q_atomic_valid(spark, sf_dir):
    s = V.spans(spark, sf_dir).withColumns({"k": F.col("item") % 5, "m": F.col("start") + F.floor((F.col("end") - F.col("start")) / 2)})
    two = F.array(
        F.struct(F.lit(1).alias("action_id"), F.col("start"), F.when(F.col("k") == 0, F.col("end")).otherwise(F.col("m")).alias("end")),
        F.struct(F.when(F.col("k") == 1, 3).otherwise(2).alias("action_id"), F.when(F.col("k") == 2, F.col("m") + 1).otherwise(F.col("m")).alias("start"), F.col("end").alias("end")),
    )
    acts = s.select("item", "step_id", F.col("start").alias("step_start"), F.col("end").alias("step_end"), F.explode(F.when(F.col("k") == 0, F.slice(two, F.lit(1), F.lit(1))).otherwise(two)).alias("x"))
    return intervals.atomic_errors(acts.select("item", "step_id", "step_start", "step_end", "x.*"))


@query(S.MERGE_TINY)
def q_merge_tiny(spark, sf_dir):
    s = V.spans(spark, sf_dir).select("item", F.lit(1).cast("long").alias("step_id"), F.col("step_id").alias("action_id"), "start", "end")
    return intervals.merge_tiny(s, 9)


@query(f"WITH {STEPS} SELECT item, step_id, size AS frames, greatest(0, least(size, 50 - coalesce(sum(size) OVER (PARTITION BY item ORDER BY step_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::INT AS taken FROM steps")
def q_frame_budget(spark, sf_dir):
    s = V.steps(spark, sf_dir).select("item", F.col("step_id").alias("place"), F.col("size").alias("frames"))
    return intervals.frame_budget(s).withColumnRenamed("place", "step_id")


@query(f"""WITH {_FRAMES}, c AS (SELECT item, frame_index, ceil(count(*) OVER (PARTITION BY item) / 50.0)::BIGINT AS c FROM frames), p AS (SELECT item, ((frame_index - 1) // c)::INT AS panel, min(frame_index) AS a, max(frame_index) AS b, count(*) AS n FROM c GROUP BY 1, 2)
SELECT item, panel, CASE WHEN n = 1 THEN a::VARCHAR ELSE a || '-' || b END AS label, n FROM p""")
def q_chunk_panels(spark, sf_dir):
    return intervals.panels(_frames(spark, sf_dir).select("item", "frame_index"))


@query("""WITH k AS (SELECT p_partkey, p_size AS n, 7 AS k FROM part) SELECT p_partkey, array_to_string(CASE WHEN n <= k THEN list_transform(range(0, n), lambda i: i + 1) ELSE list_transform(range(0, k), lambda i: round_even(i * (n - 1) / (k - 1)::DOUBLE, 0)::BIGINT + 1) END, ',') AS frames FROM k""")
def q_uniform_index(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(media.sample_indices(F.col("p_size"), F.lit(7)), lambda i: i.cast("string")), ",").alias("frames"))


# --- joins ---


@query(f"""WITH {STEPS}, t AS (SELECT item, step_id + 1 AS id, step_id - 1 AS pos, step_goal FROM steps), r AS (SELECT o_orderkey AS item, (o_custkey % 9)::BIGINT AS k FROM orders),
c AS (SELECT r.item, r.k, t.id, t.step_goal, CASE WHEN t.id = r.k THEN 1 WHEN t.pos = r.k THEN 2 ELSE 3 END AS p, t.pos FROM r JOIN t ON t.item = r.item AND (t.id = r.k OR t.pos = r.k OR t.pos + 1 = r.k)),
b AS (SELECT item, arg_min(id, p * 1000 + pos) AS id, arg_min(step_goal, p * 1000 + pos) AS g FROM c GROUP BY item)
SELECT r.item, r.k AS step_index, b.id AS matched_step_id, b.g AS matched_goal FROM r LEFT JOIN b ON b.item = r.item""")
def q_step_match(spark, sf_dir):
    s = V.steps(spark, sf_dir).select("item", (F.col("step_id") - 1).alias("pos"), (F.col("step_id") + 1).alias("step_id"), "step_goal")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 9).alias("step_index"))
    return resolve.match_step(rows, s).select("item", "step_index", "matched_step_id", "matched_goal")


@query(f"WITH {STEPS} SELECT item, trim(lower(step_goal), ' ') AS goal_key, max(step_id) AS step_id FROM steps GROUP BY 1, 2")
def q_goal_lookup_last(spark, sf_dir):
    return resolve.goal_lookup(V.steps(spark, sf_dir).withColumn("pos", F.col("step_id")))


@query(f"""WITH {STEPS}, r AS (SELECT o_orderkey AS item, lower(split_part(p_name, ' ', 1)) AS wanted, (o_custkey % 40)::BIGINT AS id FROM orders JOIN part ON p_partkey = o_custkey),
c AS (SELECT r.item, s.step_id, CASE WHEN s.step_id = r.id THEN 1 WHEN contains(lower(s.step_goal), r.wanted) THEN 2 ELSE 3 END AS way FROM r LEFT JOIN steps s ON s.item = r.item)
SELECT item, arg_min(step_id, way * 1000 + step_id) AS step_id, min(way)::INT AS way FROM c WHERE step_id IS NOT NULL GROUP BY item UNION ALL SELECT item, NULL, NULL FROM c WHERE step_id IS NULL""")
def q_theta_goal(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    rows = o.join(p, o.o_custkey == p.p_partkey).select(F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("row_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("wanted"), (F.col("o_custkey") % 40).alias("wanted_id"))
    s = V.steps(spark, sf_dir).withColumn("pos", F.col("step_id"))
    out = resolve.theta_goal(rows, s)
    return out.select("item", "step_id", F.when(F.col("step_id").isNotNull(), F.col("way")).alias("way"))


@query("""WITH i AS (SELECT '/c/' || doc_id || '/prefix_clips/prefix_step' || lpad((doc_id % 12)::VARCHAR, 2, '0') || '.mp4' AS path FROM documents WHERE doc_id % 3 = 0 UNION ALL
SELECT '/c/' || doc_id || '/cumulative_last_frame_segments/segment_start_to_step' || (doc_id % 12) || '.mp4' FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT '/src/' || doc_id || '.mp4' FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id AS row_id, CASE WHEN doc_id % 3 = 0 THEN '/c/' || doc_id || '/prefix_clips/prefix_step' || lpad((doc_id % 12)::VARCHAR, 2, '0') || '.mp4'
WHEN doc_id % 4 = 0 THEN '/c/' || doc_id || '/cumulative_last_frame_segments/segment_start_to_step' || CASE WHEN doc_id % 12 > 9 THEN (doc_id % 12)::VARCHAR ELSE (doc_id % 12)::VARCHAR END || '.mp4' WHEN doc_id % 2 = 0 THEN '/src/' || doc_id || '.mp4' END AS found FROM documents""")
def q_path_priority(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), (F.col("doc_id") % 12).alias("step"), F.concat(F.lit("/c/"), F.col("doc_id")).alias("folder"), F.concat(F.lit("/src/"), F.col("doc_id"), F.lit(".mp4")).alias("src"))
    rows = d.select("row_id", resolve.prefix_candidates(F.col("folder"), F.col("step"), F.col("src")).alias("candidates"))
    have = d.select(F.explode(F.array_compact(F.array(F.when(F.col("row_id") % 3 == 0, F.concat("folder", F.lit("/prefix_clips/prefix_step"), F.lpad(F.col("step").cast("string"), 2, "0"), F.lit(".mp4"))), F.when(F.col("row_id") % 4 == 0, F.concat("folder", F.lit("/cumulative_last_frame_segments/segment_start_to_step"), F.col("step").cast("string"), F.lit(".mp4"))), F.when(F.col("row_id") % 2 == 0, F.col("src"))))).alias("path"))
    return resolve.first_file(rows, have).select("row_id", "found")


@query("SELECT event_id, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 50 = 1)")
def q_resume_anti(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return resume.pending(e, e.where("event_id % 50 = 1"), "user_id").select("event_id", "event_type")


@query("""WITH c AS (SELECT md5(text) AS fp, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents), d AS (SELECT md5(text) AS fp, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT c.doc_id, c.fp FROM c LEFT JOIN d ON d.fp = c.fp WHERE c.k > coalesce(d.n, 0)""")
def q_bag_anti(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("fp"))
    return resume.pending_copies(d, d.where("doc_id % 2 = 1"), "fp", "doc_id").select("doc_id", "fp")


@query("""WITH f AS (SELECT epoch_us(ts) / 1e6::DOUBLE AS t, min(event_id) AS i FROM events GROUP BY 1), p AS (SELECT event_id AS point_id, epoch_us(ts) / 1e6::DOUBLE + 7.25::DOUBLE AS t FROM events),
b AS (SELECT p.point_id, p.t, f.t AS bt, f.i AS bi FROM p ASOF LEFT JOIN f ON p.t >= f.t), a AS (SELECT p.point_id, f.t AS nt, f.i AS ai FROM p ASOF LEFT JOIN f ON p.t <= f.t)
SELECT b.point_id, CASE WHEN nt IS NULL OR t - bt < nt - t OR (t - bt = nt - t AND bi < ai) THEN bi ELSE ai END AS frame_index, round(least(coalesce(t - bt, 1e18), coalesce(nt - t, 1e18)), 3)::DOUBLE AS gap FROM b JOIN a ON a.point_id = b.point_id""")
def q_nearest_frame(spark, sf_dir):
    """Each event, a little later, with the event nearest in time."""
    e = table(spark, sf_dir, "events").select("event_id", (F.unix_micros("ts") / F.lit(1e6)).alias("t"))
    frames = e.select(F.col("event_id").alias("frame_index"), F.col("t").alias("ts"))
    points = e.select(F.col("event_id").alias("point_id"), (F.col("t") + F.lit(7.25)).alias("t"))
    return resolve.nearest(points, frames).select("point_id", "frame_index", F.round("gap", 3).alias("gap"))


@query(f"""WITH {STEPS}, p AS (SELECT item, step_id, step_goal, lag(step_goal) OVER (PARTITION BY item ORDER BY step_id) AS prev FROM steps), t AS (SELECT item, step_id, {_TERMS('step_goal')} AS x, {_TERMS("coalesce(prev, '')")} AS y FROM p)
SELECT item, step_id FROM t WHERE least(len(x), len(y)) = 0 OR len(list_intersect(x, y))::DOUBLE / least(len(x), len(y)) <= 0.75""")
def q_cross_task_removal(spark, sf_dir):
    """Two answers for each step, its own goal and the one before; the first goes if they nearly agree."""
    s = steps.neighbours(V.steps(spark, sf_dir))
    a = s.select("item", "step_id", F.concat_ws("-", "item", "step_id").alias("row_id"), F.col("step_goal").alias("answer"))
    b = s.where("prev_goal is not null").select("item", "step_id", F.col("prev_goal").alias("answer"))
    return resolve.overlapping_rows(a, b, ["item", "step_id"]).select("item", "step_id")


@query(f"""WITH {STEPS}, f AS (SELECT item, step_id, CASE WHEN step_id % 5 = 0 THEN step_id + 100 ELSE step_id END AS k, CASE WHEN step_id % 3 = 0 THEN 2 ELSE 1 END AS n FROM steps), s AS (SELECT item, k, sum(n) AS n FROM f GROUP BY 1, 2)
SELECT coalesce(d.item, s.item) AS item, coalesce(d.step_id, s.k) AS step_id, CASE WHEN s.n IS NULL THEN 'missing' WHEN d.item IS NULL THEN 'unexpected' WHEN s.n > 1 THEN 'duplicate' ELSE 'both' END AS status FROM steps d FULL JOIN s ON s.item = d.item AND s.k = d.step_id""")
def q_step_id_compare(spark, sf_dir):
    s = V.steps(spark, sf_dir).select("item", "step_id")
    found = s.withColumn("n", F.when(F.col("step_id") % 3 == 0, 2).otherwise(1)).select("item", F.when(F.col("step_id") % 5 == 0, F.col("step_id") + 100).otherwise(F.col("step_id")).alias("step_id"), F.explode(F.sequence(F.lit(1), "n")))
    return resolve.compared_ids(s, found)


@query(f"WITH {QA}, r AS (SELECT *, row_number() OVER (PARTITION BY task_name ORDER BY conv_id, turn) AS k FROM qa) SELECT task_name, sample_id FROM r WHERE k <= 3")
def q_limit_per_task(spark, sf_dir):
    return rank.limit_per_group(V.qa(spark, sf_dir), "task_name", [F.col("conv_id"), F.col("turn")], 3).select("task_name", "sample_id")


# --- question generation ---


def _sql_question(task: int, item: str, step: str) -> str:
    options = generate.TEMPLATES[task]
    return f"[{', '.join(repr(x) for x in options)}][(('0x' || substr(md5('{task}:' || {item} || ':' || {step}), 1, 12))::BIGINT % {len(options)} + 1)::INT]"


def _sql_rows(task: int, step: str, answer: str, evidence: str, source: str) -> str:
    return f"SELECT '{NAMES[task]}' AS task_name, item, {step}::BIGINT AS step_id, {_sql_question(task, 'item', step)} AS question, trim({answer}, ' ') AS answer, {evidence} AS evidence FROM {source}"


@query(f"WITH {STEPS}, p AS (SELECT item, count(*) AS n, arg_max(step_goal, step_id) AS g FROM steps GROUP BY item) {_sql_rows(8, '0', 'g', chr(39) + 'prefix_step' + chr(39) + ' || n', 'p')}")
def q_gen_task08(spark, sf_dir):
    p = V.steps(spark, sf_dir).groupBy("item").agg(F.count(F.lit(1)).alias("n_steps"), F.max_by("step_goal", "step_id").alias("high_level_goal"))
    return generate.goal_recognition(p)


@query(f"WITH {STEPS} {_sql_rows(10, 'step_id', 'step_goal', chr(39) + 'clip_of_step' + chr(39) + ' || step_id', 'steps')}")
def q_gen_task10(spark, sf_dir):
    return generate.step_goals(V.steps(spark, sf_dir))


@query(f"WITH {STEPS} {_sql_rows(13, 'step_id', 'step_goal', chr(39) + 'clip_of_step' + chr(39) + ' || step_id', 'steps')} WHERE len(regexp_extract_all(step_goal, '\\S+')) >= 4")
def q_gen_task13(spark, sf_dir):
    return generate.rationales(V.steps(spark, sf_dir).withColumn("rationale", F.col("step_goal")))


@query(f"""WITH {STEPS}, p AS (SELECT item, step_id AS a, step_goal AS g, lead(step_id) OVER w AS step_id, lead(step_goal) OVER w AS ng FROM steps WINDOW w AS (PARTITION BY item ORDER BY step_id)),
t AS (SELECT *, {_TERMS('g')} AS x, {_TERMS('ng')} AS y FROM p WHERE step_id IS NOT NULL AND {sql_h('dep', "item || '-' || step_id")} % 2 = 0),
u AS (SELECT * FROM t WHERE least(len(x), len(y)) = 0 OR len(list_intersect(x, y))::DOUBLE / least(len(x), len(y)) <= 0.8)
{_sql_rows(14, 'step_id', "g || ' -> ' || ng", "'clip_of_step' || a || '+clip_of_step' || step_id", 'u')}""")
def q_gen_task14(spark, sf_dir):
    s = V.steps(spark, sf_dir)
    return generate.dependencies(s.withColumn("independence", F.when(V.h("dep", F.concat_ws("-", "item", "step_id")) % 2 == 0, "yes").otherwise("no")))


@query(f"""WITH {STEPS}, p AS (SELECT item, step_id, lead(step_goal) OVER (PARTITION BY item ORDER BY step_id) AS ng, count(*) OVER (PARTITION BY item) AS n FROM steps)
{_sql_rows(15, 'step_id', 'ng', "'prefix_step' || step_id", 'p')} WHERE ng IS NOT NULL AND n >= 3""")
def q_gen_task15(spark, sf_dir):
    return generate.next_steps(V.steps(spark, sf_dir))


@query(f"WITH {_MIDDLE} {_sql_rows(16, '0', 'middle_goals', chr(39) + 'first_and_last_clip' + chr(39), 'mid')}")
def q_gen_task16(spark, sf_dir):
    return generate.middle_infill(V.steps(spark, sf_dir))


@query(f"WITH {_NEXT_K} {_sql_rows(17, 'step_id', 'next_goals', chr(39) + 'prefix_step' + chr(39) + ' || step_id', 'nk')}")
def q_gen_task17(spark, sf_dir):
    return generate.next_k_steps(V.steps(spark, sf_dir))


@query(S.BAD_PLAN)
def q_bad_plan(spark, sf_dir):
    s = V.steps(spark, sf_dir)
    return generate.bad_plans(s, steps.goal_pool(s))


@query(f"""WITH {STEPS} {_sql_rows(19, 'step_id', "'Then ' || step_goal || ' fails.'", "'clip_of_step' || step_id", 'steps')} WHERE step_id % 2 = 0""")
def q_gen_task19(spark, sf_dir):
    s = V.steps(spark, sf_dir).withColumns({"challenge": F.when(F.col("step_id") % 2 == 0, "What if not?").otherwise(" "), "expected_outcome": F.concat(F.lit("Then "), "step_goal", F.lit(" fails."))})
    return generate.counterfactuals(s)


@query(f"""WITH {STEPS} {_sql_rows(20, 'step_id', "'Repeat ' || step_goal", "'clip_of_step' || step_id", 'steps')} WHERE step_id % 3 = 0""")
def q_gen_task20(spark, sf_dir):
    s = V.steps(spark, sf_dir).withColumns({"failure_reason": F.when(F.col("step_id") % 3 == 0, "slipped").otherwise(""), "recovery_strategy": F.concat(F.lit("Repeat "), "step_goal")})
    return generate.recoveries(s)


def _sql_moment(task: int, *key: str) -> str:
    options = moments.QUESTIONS[task]
    joined = " || ':' || ".join([f"'{task}'", *key])
    return f"[{', '.join(repr(x) for x in options)}][(('0x' || substr(md5({joined}), 1, 12))::BIGINT % {len(options)} + 1)::INT]"


@query(S.CONDITIONS)
def q_gen_conditions(spark, sf_dir):
    return moments.conditions(V.causal_lines(spark, sf_dir), V.causal_points(spark, sf_dir))


@query(S.FEASIBILITY)
def q_gen_task03(spark, sf_dir):
    return moments.feasibility(V.causal_lines(spark, sf_dir), V.causal_points(spark, sf_dir))


_ONCE = "SELECT task_name, item, step_id, question, answer, evidence FROM (SELECT *, row_number() OVER (PARTITION BY item, answer ORDER BY evidence) AS k FROM r) WHERE k = 1"
_KEYFRAME = "'keyframe_' || (p_size % 2 + 1) || '_of_step' || step_id"


@query(f"""WITH {CAUSAL}, r AS (SELECT '{NAMES[4]}' AS task_name, item, step_id, {_sql_moment(4, 'item', 'step_id', '(p_size % 2 + 1)')} AS question, 'The main object is the ' || n || ', which serves as ' ||
CASE WHEN t[1] IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END || ' ' || t || '. Physically, friction holds the ' || n || '.' AS answer, {_KEYFRAME} AS evidence FROM causal WHERE p_size % 7 <> 0) {_ONCE}""")
def q_gen_task04(spark, sf_dir):
    return moments.affordances(V.causal_steps(spark, sf_dir))


@query(S.CHAINS)
def q_gen_task05(spark, sf_dir):
    return moments.causal_chains(V.causal_lines(spark, sf_dir), points=V.causal_points(spark, sf_dir))


@query(S.KEY_OBJECTS)
def q_gen_task09(spark, sf_dir):
    s = V.causal_steps(spark, sf_dir)
    pool = rank.global_rank(s.select(F.lower("patient").alias("object")).distinct(), F.md5("object"), F.col("object"), name="place").withColumn("place", F.col("place") - 1)
    return moments.key_objects(s, pool)


@query(f"""WITH {CAUSAL} SELECT '{NAMES[11]}' AS task_name, item, step_id, {_sql_moment(11, 'item', 'step_id')} AS question, 'In this clip, the person is ' ||
CASE WHEN l_linenumber % 2 = 0 THEN 'lifting the ' || n || ' and placing it' ELSE 'turning ' || n END || '.' AS answer, 'clip_of_step' || step_id AS evidence FROM causal""")
def q_gen_task11(spark, sf_dir):
    return moments.action_phrases(V.causal_steps(spark, sf_dir))


@query(f"""WITH {CAUSAL}, r AS (SELECT '{NAMES[12]}' AS task_name, item, step_id, {_sql_moment(12, 'item', 'step_id', '(p_size % 2 + 1)')} AS question, 'The ' || n || ' changes its place.' AS answer, {_KEYFRAME} AS evidence FROM causal WHERE p_size % 3 <> 0) {_ONCE}""")
def q_gen_task12(spark, sf_dir):
    return moments.state_changes(V.causal_steps(spark, sf_dir))


_GOAL_STOP = ", ".join(repr(x) for x in schema.GOAL_STOPWORDS)


@query(f"""WITH {STEPS}, g AS (SELECT item, step_id, step_goal AS g, list_filter(list_distinct(regexp_extract_all(lower(step_goal), '\\S+')), lambda w: NOT list_contains([{_GOAL_STOP}], w)) AS k FROM steps),
n AS (SELECT *, lead(k) OVER (PARTITION BY item ORDER BY step_id) AS nk FROM g),
c AS (SELECT item, count(*) AS n, count(DISTINCT g) AS d, bool_or(nk IS NOT NULL AND least(len(k), len(nk)) > 0 AND len(list_intersect(k, nk))::DOUBLE / least(len(k), len(nk)) > 0.7) AS over,
 bool_or(len(list_filter(regexp_extract_all(lower(g), '\\S+'), lambda w: length(w) > 2 AND NOT list_contains([{_GOAL_STOP}], w))) < 3) AS vague FROM n GROUP BY item)
SELECT item, concat_ws(',', CASE WHEN n < 3 OR n > 9 THEN 'step_count' END, CASE WHEN over THEN 'overlap' END, CASE WHEN vague THEN 'vague' END, CASE WHEN d < n THEN 'duplicate_goal' END) AS errors FROM c""")
def q_draft_errors(spark, sf_dir):
    return schema.draft_errors(V.steps(spark, sf_dir))


@query(f"""WITH {STEPS}, f AS (SELECT item, step_id, CASE item % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'maybe' WHEN 2 THEN '' ELSE 'no' END AS flag, CASE WHEN item % 3 = 0 THEN 'since' ELSE '' END AS detail FROM steps)
SELECT * FROM (SELECT item, step_id, CASE WHEN step_id = 1 AND flag <> '' THEN 'first_step' WHEN step_id > 1 AND flag NOT IN ('yes', 'no') THEN 'not_yes_or_no' WHEN flag = 'yes' AND detail = '' THEN 'no_detail' WHEN flag <> 'yes' AND detail <> '' THEN 'detail_without_yes' END AS error FROM f) WHERE error IS NOT NULL""")
def q_independence(spark, sf_dir):
    flag = F.element_at(F.array(*[F.lit(x) for x in ("yes", "maybe", "", "no")]), (F.col("item") % 4 + 1).cast("int"))
    return schema.independence_errors(V.steps(spark, sf_dir).withColumns({"independence": flag, "detail_independence": F.when(F.col("item") % 3 == 0, "since").otherwise("")}))


def _plan_json():
    """Plans of one step as JSON, whole or with one fault by the item's number."""
    lists = ", ".join(f'"{k}": ["The cup is here."]' for k in schema.CAUSAL_LISTS)
    frame = lambda i: F.concat(F.lit('{"frame_index": '), i, F.lit(f', "action_state_change_description": "it moves", "causal_chain": {{{lists}}}, "interaction": {{"patient": "cup", "affordance_type": "holdable", "mechanism": "grip"}}}}'))
    k = F.col("o_orderkey") % 6
    goal = F.when(k == 1, F.lit("see frame_12")).when(k == 2, F.lit("")).otherwise(F.lit("lift the cup"))
    second = F.when(k == 3, F.lit("3")).otherwise(F.lit("9"))
    sid = F.when(k == 4, F.lit("true")).otherwise(F.lit("1"))
    more = F.when(k == 5, F.lit(', "note": "x"')).otherwise(F.lit(""))
    return F.concat(
        F.lit('{"high_level_goal": "tidy up", "steps": [{"step_id": '), sid, F.lit(', "step_goal": "'), goal,
        F.lit(f'", "rationale": "it must go", "causal_chain": {{"agent": "person", "action": "lift", "patient": "cup", {lists}}}, "counterfactual_challenge_question": "What if it slips?", "expected_challenge_outcome": "It falls.", "failure_reflecting": {{"reason": "wet", "recovery_strategy": "dry it"}}, "critical_frames": ['),
        frame(F.lit("3")), F.lit(", "), frame(second), F.lit("]"), more, F.lit("}]}"),
    )


@query("""SELECT o_orderkey AS item, CASE o_orderkey % 6 WHEN 1 THEN 'steps[0].step_goal:leak' WHEN 2 THEN 'steps[0].step_goal:empty' WHEN 3 THEN 'steps[0].critical_frames:equal' WHEN 4 THEN 'steps[0].step_id:not_int' WHEN 5 THEN 'steps[0]:extra_keys' ELSE '' END AS errors FROM orders""")
def q_plan_schema(spark, sf_dir):
    # keys are dealt before they become plans: a few row groups of them are hours of checks
    keys = table(spark, sf_dir, "orders").select("o_orderkey").repartition(4 * spark.sparkContext.defaultParallelism)
    plans = keys.select(F.col("o_orderkey").alias("item"), F.parse_json(_plan_json()).alias("plan"))
    return schema.plan_errors(plans).select("item", F.array_join("errors", ",").alias("errors"))


@query(S.REWRITE_ACCEPT)
def q_rewrite_accept(spark, sf_dir):
    rows = V.rewards(spark, sf_dir)
    found = rewrite.problems(F.col("response"), F.col("step_goal"), F.lit("Which step is shown?"), F.array("step_goal"), F.array(F.lit("kettle")))
    return rows.select("item", "step_id", F.array_join(found, ",").alias("problems"))


@query(S.ASCII_NAMES)
def q_ascii_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", morph.ascii_name(F.concat(F.lit("É-"), "p_name")).alias("name"))


# --- audits ---


def _audit_rows(spark, sf_dir):
    evidence = F.element_at(F.array(*[F.lit(x) for x in ("keyframe_single", "video_clip", "video_clip_pair")]), (F.col("conv_id") % 3 + 1).cast("int"))
    folder = F.when(F.col("conv_id") % 11 == 0, "elsewhere").otherwise(F.col("task_name"))
    return V.qa(spark, sf_dir).select("sample_id", "task_name", folder.alias("folder"), "question", "answer", (F.col("turn") % 2).alias("n_images"), (F.col("conv_id") % 3).alias("n_videos"), evidence.alias("evidence_type"))


_AUDIT = f"""{QA}, r AS (SELECT *, ['keyframe_single', 'video_clip', 'video_clip_pair'][(conv_id % 3 + 1)::INT] AS e, turn % 2 AS ni, conv_id % 3 AS nv,
 regexp_matches(question, '(?i)' || '{_LEAK}') OR regexp_matches(answer, '(?i)' || '{_LEAK}') AS leaks FROM qa),
i AS (SELECT sample_id, task_name, 'error' AS severity, 'folder_mismatch' AS code FROM r WHERE conv_id % 11 = 0 UNION ALL SELECT sample_id, task_name, 'error', 'empty_question' FROM r WHERE question = '' UNION ALL
 SELECT sample_id, task_name, 'error', 'empty_answer' FROM r WHERE answer = '' UNION ALL SELECT sample_id, task_name, 'error', 'leak' FROM r WHERE leaks UNION ALL
 SELECT sample_id, task_name, 'error', 'evidence_count' FROM r WHERE (e = 'keyframe_single' AND ni <> 1) OR (e = 'video_clip' AND nv <> 1) OR (e = 'video_clip_pair' AND nv <> 2) UNION ALL
 SELECT sample_id, task_name, 'warning', 'no_question_mark' FROM r WHERE question <> '' AND NOT ends_with(question, '?') UNION ALL SELECT sample_id, task_name, 'warning', 'short_answer' FROM r WHERE answer <> '' AND len(regexp_extract_all(answer, '\\S+')) < 3)"""


@query(f"WITH {_AUDIT} SELECT * FROM i")
def q_audit_shallow(spark, sf_dir):
    return audit.shallow_issues(_audit_rows(spark, sf_dir))


@query(f"""WITH {_AUDIT}, n AS (SELECT task_name, count(*) AS samples FROM qa GROUP BY 1), s AS (SELECT task_name, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM i GROUP BY 1)
SELECT n.task_name, samples, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM n LEFT JOIN s ON s.task_name = n.task_name""")
def q_issue_summary(spark, sf_dir):
    rows = _audit_rows(spark, sf_dir)
    return audit.totals(rows, audit.shallow_issues(rows))


@query("""WITH t AS (SELECT DISTINCT user_id, event_type FROM events), e AS (SELECT DISTINCT event_type FROM events UNION SELECT 'refund'), u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, coalesce(string_agg(e.event_type, ',' ORDER BY e.event_type) FILTER (WHERE t.user_id IS NULL), '') AS missing FROM u CROSS JOIN e LEFT JOIN t ON t.user_id = u.user_id AND t.event_type = e.event_type GROUP BY u.user_id""")
def q_missing_tasks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = e.select("event_type").where("event_type is not null").union(spark.createDataFrame([("refund",)], "event_type string")).distinct()
    return evaluate.missing_from(e, "user_id", "event_type", kinds).select("user_id", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {REWARDS}, o AS (SELECT item, step_id, response, list_distinct(list_filter(regexp_extract_all(lower(step_goal), '\\S+'), lambda w: length(w) >= 4)) AS k FROM rewards),
f AS (SELECT item, step_id, len(k) AS n, len(list_filter(k, lambda w: contains(lower(response), w))) AS m FROM o) SELECT item, step_id, round(CASE WHEN n = 0 THEN 0.0 ELSE m::DOUBLE / n END, 6) AS found, n = 0 OR m::DOUBLE / n >= 0.5 AS grounded FROM f""")
def q_goal_grounding(spark, sf_dir):
    rows = V.rewards(spark, sf_dir).select("item", "step_id", F.col("response").alias("answer"), F.col("step_goal").alias("goal"))
    return audit.goal_word_share(rows).select("item", "step_id", F.round("found", 6).alias("found"), "grounded")


@query(S.STREAM_DEDUPE)
def q_stream_dedupe(spark, sf_dir):
    """Extension: first event of each user over a file stream read to its end."""
    import uuid

    from quern.session import shared_folder
    from quern.streaming.incremental import first_by_id, run_available

    folder, source = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", table(spark, sf_dir, "events")
    source.write.parquet(f"{folder}/in")
    run_available(spark, f"{folder}/in", source.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), f"{folder}/state", lambda b, i: b.write.mode("append").parquet(f"{folder}/out"), lambda s: first_by_id(s, "user_id", "ts").select("user_id"))
    return spark.read.parquet(f"{folder}/out")


from quern.catalog import more  # noqa: E402,F401  registers its queries here
