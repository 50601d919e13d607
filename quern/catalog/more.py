"""More of the catalogue: evidence files, benchmark rows, salvage, rewards, audits, run state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog import views as V
from quern.catalog.queries import _TERMS, query
from quern.catalog.sql import LOWER_FIRST, listed, span_present
from quern.catalog.views import CAUSAL, QA, REWARDS, STEPS, TRACES, sql_h, table
from quern.functions import morph, salvage, scoring, text
from quern.operators import audit, evidence, judge, qa, resolve, resume, rewrite, trace
from quern.plans import generate, intervals
from quern.session import ship
from quern.sources import benchmark, jsonl, media, sinks

# --- files of evidence ---

_DOC = "'/i/' || doc_id"


def _rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.concat(F.lit("/i/"), "doc_id").alias("folder"), (F.col("doc_id") % 13).alias("step"))


def _present(rows, *cases):
    """An index of the paths whose condition holds."""
    return rows.select(F.explode(F.array_compact(F.array(*[F.when(c, p) for c, p in cases]))).alias("path"))


@query(f"""WITH r AS (SELECT doc_id, {_DOC} AS f, doc_id % 13 AS s, CASE WHEN doc_id % 13 = 1 THEN 'start' ELSE 'step' || lpad((doc_id % 13 - 1)::VARCHAR, 2, '0') END AS b, CASE WHEN doc_id % 13 = 1 THEN 'start' ELSE 'step' || (doc_id % 13 - 1) END AS c, lpad((doc_id % 13)::VARCHAR, 2, '0') AS p FROM documents),
w AS (SELECT *, CASE WHEN s < 1 THEN NULL WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 7 = 0 THEN CASE WHEN b || p = c || s THEN 1 ELSE 2 END WHEN doc_id % 3 = 0 THEN 3 WHEN doc_id % 2 = 0 THEN 4 WHEN doc_id % 11 = 0 THEN CASE WHEN p = s::VARCHAR THEN 4 ELSE 5 END END AS way FROM r)
SELECT doc_id AS row_id, s AS step, way, f || CASE WHEN way IS NULL THEN NULL WHEN doc_id % 5 = 0 THEN '/last_frame_segments/segment_' || b || '_to_step' || p || '.mp4' WHEN doc_id % 7 = 0 THEN '/last_frame_segments/segment_' || c || '_to_step' || s || '.mp4'
WHEN doc_id % 3 = 0 THEN '/stage2/clips/' || s || '.mp4' WHEN doc_id % 2 = 0 THEN '/stage2/step_clips/step' || p || '_a.mp4' ELSE '/stage2/step_clips/step' || s || '_z.mp4' END AS found FROM w""")
def q_step_clip(spark, sf_dir):
    r = _rows(spark, sf_dir)
    k, s, f = F.col("row_id"), F.col("step"), F.col("folder")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    before = lambda form: F.when(s == 1, "start").otherwise(F.concat(F.lit("step"), form))
    segment = lambda a, b: F.concat(f, F.lit("/last_frame_segments/segment_"), a, F.lit("_to_step"), b, F.lit(".mp4"))
    index = _present(
        r,
        (k % 5 == 0, segment(before(two(s - 1)), two(s))),
        (k % 7 == 0, segment(before((s - 1).cast("string")), s.cast("string"))),
        (k % 3 == 0, F.concat(f, F.lit("/stage2/clips/"), s, F.lit(".mp4"))),
        (k % 2 == 0, F.concat(f, F.lit("/stage2/step_clips/step"), two(s), F.lit("_a.mp4"))),
        (k % 2 == 0, F.concat(f, F.lit("/stage2/step_clips/step"), two(s), F.lit("_b.mp4"))),
        (k % 11 == 0, F.concat(f, F.lit("/stage2/step_clips/step"), s, F.lit("_z.mp4"))),
    )
    segments = r.where("row_id % 3 <> 1").select("folder", "step", F.concat(F.lit(" clips/"), "step", F.lit(".mp4 ")).alias("clip_relpath"))
    return evidence.step_clip(r, index, segments).select("row_id", "step", "way", "found")


@query(f"""WITH r AS (SELECT doc_id, {_DOC} AS f, lpad((doc_id % 13)::VARCHAR, 2, '0') || '_turn/frame_' || lpad((doc_id % 120)::VARCHAR, 3, '0') AS n FROM documents)
SELECT doc_id AS row_id, CASE WHEN doc_id % 4 = 1 THEN f || '/' || n || '_b.png' WHEN doc_id % 3 = 0 THEN f || '/stage3/' || n || '_ts_1.5.jpg' WHEN doc_id % 2 = 0 THEN f || '/stage3/' || n || '_a.jpg' WHEN doc_id % 5 = 0 THEN f || '/stage3/' || n || '_c.jpeg' END AS found FROM r""")
def q_keyframe_image(spark, sf_dir):
    r = _rows(spark, sf_dir).withColumn("frame", F.col("row_id") % 120)
    k = F.col("row_id")
    name = lambda base, rest: F.concat("folder", F.lit(base), F.lpad(F.col("step").cast("string"), 2, "0"), F.lit("_turn/frame_"), F.lpad(F.col("frame").cast("string"), 3, "0"), F.lit(rest))
    index = _present(r, (k % 4 == 1, name("/", "_b.png")), (k % 3 == 0, name("/stage3/", "_ts_1.5.jpg")), (k % 2 == 0, name("/stage3/", "_a.jpg")), (k % 5 == 0, name("/stage3/", "_c.jpeg")))
    return evidence.keyframe_image(r, index).select("row_id", "found")


@query(f"""WITH {STEPS}, s AS (SELECT item, step_id, lpad(step_id::VARCHAR, 2, '0') AS p, replace(lower(step_goal), ' ', '_') AS g, size FROM steps)
SELECT item, step_id, '/i/' || item || '/stage2/step_clips/step' || p || '_' || g || '.mp4' AS clip, '/i/' || item || '/cumulative_last_frame_segments/segment_start_to_step' || p || '_last.mp4' AS prefix,
'/i/' || item || '/stage3/' || p || '_' || g || '/frame_' || lpad(size::VARCHAR, 3, '0') || CASE WHEN size % 2 = 0 THEN '_ts_' || size || '.jpg' ELSE '.jpg' END AS keyframe FROM s""")
def q_built_paths(spark, sf_dir):
    s = V.steps(spark, sf_dir)
    folder, goal, step, n = F.concat(F.lit("/i/"), "item"), F.concat(F.lit(' "'), F.col("step_goal"), F.lit("', ")), F.col("step_id"), F.col("size")
    time = F.when(n % 2 == 0, n.cast("string"))
    return s.select("item", "step_id", evidence.built_clip(folder, step, goal).alias("clip"), evidence.built_prefix(folder, step).alias("prefix"), evidence.built_keyframe(folder, step, n, goal, time).alias("keyframe"))


@query(f"""WITH {STEPS}, m AS (SELECT item, step_id AS i, 'f' || size || '.jpg' AS p FROM steps WHERE step_id % 4 <> 0)
SELECT s.item, s.step_id, s.step_id AS "start", s.step_id + 1 AS "end", a.p AS start_image, b.p AS end_image FROM steps s LEFT JOIN m a ON a.item = s.item AND a.i = s.step_id LEFT JOIN m b ON b.item = s.item AND b.i = s.step_id + 1""")
def q_manifest_images(spark, sf_dir):
    s = V.steps(spark, sf_dir)
    manifest = s.where("step_id % 4 <> 0").select("item", F.col("step_id").alias("frame_index"), F.concat(F.lit("f"), "size", F.lit(".jpg")).alias("image_relpath"))
    return evidence.manifest_images(s.select("item", "step_id", F.col("step_id").alias("start"), (F.col("step_id") + 1).alias("end")), manifest)


@query(f"""WITH {STEPS} SELECT item, step_id AS step, CASE WHEN size % 3 = 0 THEN 1 WHEN size % 3 = 1 AND size % 2 = 0 THEN 2 WHEN size % 5 > 1 THEN 3 END AS way,
CASE WHEN size % 3 = 0 THEN size / 4.0 WHEN size % 3 = 1 AND size % 2 = 0 THEN size / 2.0 WHEN size % 5 > 1 THEN size / 8.0 END::DOUBLE AS start_sec FROM steps""")
def q_clip_start(spark, sf_dir):
    s = V.steps(spark, sf_dir).select("item", F.col("step_id").alias("step"), "size")
    metas = s.where("size % 3 < 2").select("item", "step", F.explode(F.array(F.lit("01_b"), F.lit("01_a"))).alias("step_dir"), F.when(F.col("size") % 3 == 0, (F.col("size") / 4).cast("string")).otherwise(F.lit("soon")).alias("clip_start_sec"))
    metas = metas.withColumn("clip_start_sec", F.when(F.col("step_dir") == "01_b", F.lit("99999")).otherwise(F.col("clip_start_sec"))).where("step_dir = '01_a' or size(array(clip_start_sec)) = 0")
    segments = s.where("size % 2 = 0").where("size % 3 = 1").select("item", "step", (F.col("size") / 2).alias("start_sec"))
    manifests = s.where("size % 5 > 1").select("item", "step", F.explode(F.array(F.lit("01_a"), F.lit("01_b"))).alias("step_dir"), "size")
    manifests = manifests.select("item", "step", "step_dir", F.explode(F.when(F.col("step_dir") == "01_a", F.array(F.col("size") / 8 + 1, F.col("size") / 8)).otherwise(F.array(F.lit(-1.0)))).alias("ts"))
    rows = s.select(F.concat_ws("-", "item", "step").alias("row_id"), "item", "step")
    return evidence.clip_start(rows, metas, segments, manifests).select("item", "step", "way", "start_sec")


@query(f"""WITH {STEPS} SELECT item, step_id AS step, CASE WHEN size % 4 = 0 THEN lpad(step_id::VARCHAR, 2, '0') || '_' || replace(lower(step_goal), ' ', '_') WHEN size % 4 = 1 THEN '01_b' ELSE '01_a' END AS step_dir,
CASE WHEN size % 4 = 0 THEN 'new' WHEN size % 4 = 3 THEN 'other' ELSE 'same' END AS state FROM steps""")
def q_step_folder(spark, sf_dir):
    s = V.steps(spark, sf_dir).select(F.concat_ws("-", "item", "step_id").alias("row_id"), "item", F.col("step_id").alias("step"), F.col("step_goal").alias("goal"), F.lit("c.mp4").alias("clip"), F.col("size").cast("double").alias("start_sec"), (F.col("size") + 2.0).alias("end_sec"))
    k = F.floor("start_sec") % 4
    folders = s.where(k > 0).withColumn("step_dir", F.explode(F.array(F.lit("01_a"), F.lit("01_b"))))
    off = F.when(k == 3, 0.5).when((k == 1) & (F.col("step_dir") == "01_a"), 0.01).otherwise(0.0005)
    return evidence.step_folder(s, folders.select("item", "step", "step_dir", "clip", (F.col("start_sec") + off).alias("start_sec"), "end_sec")).select("item", "step", "step_dir", "state")


@query(f"""WITH {STEPS}, f AS (SELECT item, step_id AS i, size % 3 AS d FROM steps), n AS (SELECT item, max(i) AS n FROM f GROUP BY item), u AS (SELECT item, min(i) AS lo, max(i) AS hi FROM (SELECT item, d, min(i) AS i FROM f GROUP BY 1, 2) GROUP BY item)
SELECT n.item, coalesce(a.d = b.d, false) AS identical, CASE WHEN a.d = b.d AND lo < hi THEN lo ELSE 1 END AS first, CASE WHEN a.d = b.d AND lo < hi THEN hi ELSE n END AS second FROM n JOIN u ON u.item = n.item LEFT JOIN f a ON a.item = n.item AND a.i = 1 LEFT JOIN f b ON b.item = n.item AND b.i = n""")
def q_keyframe_pairs(spark, sf_dir):
    s = V.steps(spark, sf_dir)
    frames = s.select("item", F.col("step_id").alias("frame_index"), (F.col("size") % 3).alias("digest"))
    return evidence.keyframe_pairs(s.groupBy("item").agg(F.lit(1).cast("long").alias("first"), F.max("step_id").alias("second")), frames)


@query(f"""WITH {STEPS}, f AS (SELECT item, step_id AS i, 1.0::DOUBLE + 2.0::DOUBLE * step_id AS ts FROM steps), n AS (SELECT item, count(*) AS n, max(ts) AS last FROM f GROUP BY item),
a AS (SELECT f.item, f.i, f.ts, g.ts AS e, n.n, n.last, 2.5::DOUBLE AS cs, 2.0::DOUBLE * n.n AS ce FROM f JOIN n ON n.item = f.item LEFT JOIN f g ON g.item = f.item AND g.i = f.i + 1),
b AS (SELECT *, greatest(0.0, least(ts - cs, ce - cs)) AS x, CASE WHEN e IS NOT NULL THEN greatest(0.0, least(e - cs, ce - cs)) ELSE ce - cs END AS y FROM a),
c AS (SELECT *, CASE WHEN y - x < 0.04 THEN least(x + 0.04, ce - cs) ELSE y END AS q FROM b)
SELECT item, i AS action_id, ts AS start_sec, coalesce(e, least(ce, last)) AS end_sec, round(CASE WHEN y - x < 0.04 AND q - x < 0.04 THEN greatest(0.0, q - 0.04) ELSE x END, 6) AS local_start, round(q, 6) AS local_end FROM c""")
def q_action_times(spark, sf_dir):
    s = V.steps(spark, sf_dir)
    one = F.lit(1).alias("step_id")
    frames = s.select("item", one, F.col("step_id").alias("place"), (F.lit(1.0) + F.lit(2.0) * F.col("step_id")).alias("ts"))
    clips = s.groupBy("item").agg(one, F.lit(2.5).alias("clip_start"), (F.lit(2.0) * F.count(F.lit(1))).alias("clip_end"))
    acts = s.select("item", one, F.col("step_id").alias("action_id"), F.col("step_id").alias("start"), (F.col("step_id") + 1).alias("end"))
    return evidence.action_times(acts, frames, clips).select("item", "action_id", "start_sec", "end_sec", F.round("local_start", 6).alias("local_start"), F.round("local_end", 6).alias("local_end"))


@query(f"""WITH {STEPS}, r AS (SELECT item, step_id, CASE WHEN step_id % 3 = 0 THEN 'none of it' ELSE upper(step_goal) END AS g, CASE WHEN step_id % 2 = 0 THEN step_id ELSE 99 END AS e FROM steps),
k AS (SELECT item, trim(lower(step_goal), ' ') AS g, min(step_id) AS s FROM steps GROUP BY 1, 2)
SELECT r.item, r.step_id AS row_step, coalesce(k.s, i.step_id) AS step_id, CASE WHEN k.s IS NOT NULL THEN 'goal' WHEN i.step_id IS NOT NULL THEN 'evidence' ELSE 'none' END AS "by" FROM r LEFT JOIN k ON k.item = r.item AND k.g = trim(lower(r.g), ' ') LEFT JOIN steps i ON i.item = r.item AND i.step_id = r.e""")
def q_plan_step(spark, sf_dir):
    s = V.steps(spark, sf_dir)
    rows = s.select("item", F.col("step_id").alias("row_step"), F.when(F.col("step_id") % 3 == 0, "none of it").otherwise(F.concat(F.upper("step_goal"), F.lit(" "))).alias("goal"), F.when(F.col("step_id") % 2 == 0, F.col("step_id")).otherwise(F.lit(99)).alias("evidence_step"))
    return evidence.plan_step(rows, s).select("item", "row_step", "step_id", "by")


@query(f"""WITH {STEPS}, f AS (SELECT item, step_id AS p, step_goal AS g, size % 4 AS t, 'Mark ' || (size % 6) || ' of ' || step_goal AS d FROM steps),
r AS (SELECT item, step_id, step_goal AS g, CASE WHEN step_id % 2 = 0 THEN size % 4 ELSE 9 END AS t, 'so: mark ' || (step_id % 6) || ' of ' || step_goal || '.' AS a FROM steps),
w AS (SELECT r.item, r.step_id, f.p, CASE WHEN f.g = r.g AND f.t = r.t THEN 1 WHEN f.g = r.g AND contains(lower(r.a), lower(substr(f.d, 1, 50))) THEN 2 ELSE 3 END AS way FROM r JOIN f ON f.item = r.item)
SELECT item, step_id, min(way) AS way, arg_min(p, way * 1000 + p) AS place FROM w GROUP BY item, step_id""")
def q_keyframe_of(spark, sf_dir):
    s = V.steps(spark, sf_dir)
    tool = (F.col("size") % 4).cast("string")
    frames = s.select("item", F.col("step_id").alias("place"), F.col("step_goal").alias("goal"), F.col("step_goal").alias("patient"), tool.alias("mechanism"), F.concat(F.lit("Mark "), F.col("size") % 6, F.lit(" of "), "step_goal").alias("description"))
    rows = s.select(F.concat_ws("-", "item", "step_id").alias("row_id"), "item", "step_id", F.col("step_goal").alias("goal"), F.col("step_goal").alias("patient"), F.when(F.col("step_id") % 2 == 0, tool).otherwise("9").alias("mechanism"), F.concat(F.lit("so: mark "), F.col("step_id") % 6, F.lit(" of "), "step_goal", F.lit(".")).alias("answer"))
    return evidence.keyframe_of(rows, frames).select("item", "step_id", "way", "place")


@query(f"WITH {STEPS}, l AS (SELECT item, list(step_goal ORDER BY step_id) AS g FROM steps GROUP BY item) SELECT item, coalesce(g[3], g[1]) AS keyframe FROM l")
def q_preferred_keyframe(spark, sf_dir):
    g = V.steps(spark, sf_dir).groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_id", "step_goal"))), lambda x: x["step_goal"]).alias("g"))
    return g.select("item", evidence.preferred(F.col("g"), 2).alias("keyframe"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'https://h/v/' || doc_id || '.mp4' WHEN 1 THEN 'data:x' WHEN 2 THEN '/m/a/' || doc_id || '.mp4' WHEN 3 THEN '/out/' || doc_id || '.mp4' ELSE '/m/b/' || doc_id || '.mp4' END AS absolute,
CASE doc_id % 5 WHEN 0 THEN 'https://h/v/' || doc_id || '.mp4' WHEN 1 THEN 'data:x' WHEN 2 THEN 'a/' || doc_id || '.mp4' WHEN 3 THEN '/out/' || doc_id || '.mp4' ELSE 'b/' || doc_id || '.mp4' END AS relative,
CASE doc_id % 5 WHEN 0 THEN 'https://h/v/' || doc_id || '.mp4' WHEN 1 THEN 'data:x' WHEN 2 THEN '/m/./x/../a/' || doc_id || '.mp4' WHEN 3 THEN '/out/' || doc_id || '.mp4' ELSE '/m/b/' || doc_id || '.mp4' END AS as_is FROM documents""")
def q_media_paths(spark, sf_dir):
    n = F.concat(F.col("doc_id").cast("string"), F.lit(".mp4"))
    said = F.element_at(F.array(F.concat(F.lit("https://h/v/"), n), F.lit("data:x"), F.concat(F.lit("/m/./x/../a/"), n), F.concat(F.lit("/out/"), n), F.concat(F.lit("b/"), n)), (F.col("doc_id") % 5 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", said.alias("p"))
    return d.select("doc_id", *[evidence.media_path(F.col("p"), "/m", mode).alias(mode) for mode in ("absolute", "relative", "as_is")])


# --- benchmark rows and guards ---


def _bench(spark, sf_dir):
    """Rows of three tasks as JSON: multiple choice and open ones, some broken."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Task_0"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("_X")).alias("task_name"))
    k = F.col("doc_id") % 7
    idf = F.when(k == 0, F.lit('"id": " "')).otherwise(F.concat(F.lit('"id": "s'), "doc_id", F.lit('"')))
    options = F.when(k == 1, F.lit('"options": ["x"]')).otherwise(F.lit('"options": {"A": "x", "B": "y"}'))
    letter = F.when(k == 2, "e").otherwise("b")
    turns = F.lit('"conversations": [{"from": "human", "value": " q1 "}, {"from": "gpt", "value": "a1"}]')
    return d.withColumns(
        {
            "row_index": F.col("doc_id"),
            "mcq": F.parse_json(F.concat(F.lit("{"), idf, F.lit(", "), options, F.lit(', "question": "why?", "answer": " '), letter, F.lit('", "gold_answer": "y"}'))),
            "open": F.parse_json(F.concat(F.lit("{"), idf, F.lit(", "), F.when(k == 3, turns).when(k == 4, F.lit('"prompt": "p"')).otherwise(F.lit('"question": "q", "answer": "a"')), F.lit("}"))),
        }
    )


@query("""WITH d AS (SELECT doc_id, doc_id % 7 AS k, 'Task_0' || (doc_id % 3 + 1) || '_X' AS task_name FROM documents WHERE doc_id % 3 < 2)
SELECT task_name, doc_id AS sample_index, CASE WHEN k = 0 THEN '' ELSE 's' || doc_id END AS sample_id, 'why?' AS question, 'y' AS reference_answer, CASE WHEN k = 2 THEN 'E' ELSE 'B' END AS gold_letter,
CASE k WHEN 0 THEN 'no_id' WHEN 1 THEN 'no_options' WHEN 2 THEN 'invalid' END AS error FROM d""")
def q_benchmark_mcq(spark, sf_dir):
    lines = _bench(spark, sf_dir).withColumn("row", F.col("mcq"))
    return benchmark.benchmark_items(lines, "mcq", ["Task_01_X", "Task_02_X"], strict=False).drop("options")


@query("""WITH d AS (SELECT doc_id, doc_id % 7 AS k, 'Task_0' || (doc_id % 3 + 1) || '_X' AS task_name FROM documents)
SELECT task_name, doc_id AS sample_index, CASE WHEN k = 0 THEN '' ELSE 's' || doc_id END AS sample_id, CASE k WHEN 3 THEN 'q1' WHEN 4 THEN 'p' ELSE 'q' END AS question, CASE k WHEN 3 THEN 'a1' WHEN 4 THEN '' ELSE 'a' END AS reference_answer,
CASE k WHEN 0 THEN 'no_id' WHEN 4 THEN 'invalid' END AS error FROM d""")
def q_benchmark_open(spark, sf_dir):
    lines = _bench(spark, sf_dir).withColumn("row", F.col("open"))
    return benchmark.benchmark_items(lines, "qa", strict=False).drop("options", "gold_letter")


@query(f"WITH {QA} SELECT task_name, count(*) AS n FROM qa WHERE starts_with(task_name, 'Task_01') OR contains(task_name, 'Step') GROUP BY task_name")
def q_task_subset(spark, sf_dir):
    rows = V.qa(spark, sf_dir).where(benchmark.selected_tasks(F.col("task_name"), ["Task_01", "Step"], exact=False))
    return rows.groupBy("task_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id AS sample_id, {sql_h('p', 'doc_id')} % 5 < 4 AND {sql_h('p', 'doc_id')} % 5 = {sql_h('g', 'doc_id')} % 4 AS correct FROM documents""")
def q_correct(spark, sf_dir):
    letter = lambda n: F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (n + 1).cast("int"))
    p = V.h("p", "doc_id") % 5
    predicted = F.when(p < 4, letter(F.least(p, F.lit(3))))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), benchmark.correct(predicted, letter(V.h("g", "doc_id") % 4)).alias("correct"))


def _listing(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")
    path = F.concat(F.lit("/v/"), F.when(k % 6 == 0, F.lit(".hidden/")).otherwise(F.lit("")), F.lit("clip"), (k % 400).cast("string"), F.when(k % 5 == 0, F.lit(".txt")).otherwise(F.lit(".MP4")))
    folder = F.concat(F.lit("/d"), F.floor(k / 400).cast("string"), path)
    return d.select(folder.alias("path"), F.concat(F.lit("/real/"), F.when(k % 4 == 0, k - k % 8).otherwise(k).cast("string")).alias("real"))


_LISTING = """l AS (SELECT '/d' || (doc_id // 400) || '/v/' || CASE WHEN doc_id % 6 = 0 THEN '.hidden/' ELSE '' END || 'clip' || (doc_id % 400) || CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.MP4' END AS path,
'/real/' || CASE WHEN doc_id % 4 = 0 THEN doc_id - doc_id % 8 ELSE doc_id END AS real FROM documents),
v AS (SELECT min(path) AS path FROM l WHERE NOT contains(path, '/.') AND ends_with(path, '.MP4') GROUP BY real), n AS (SELECT path, regexp_extract(path, '([^/]*)\\.MP4$', 1) AS stem FROM v)"""


@query(f"WITH {_LISTING} SELECT path, stem FROM n")
def q_videos(spark, sf_dir):
    return benchmark.videos(_listing(spark, sf_dir))


@query(f"WITH {_LISTING} SELECT stem, count(*) AS n FROM n GROUP BY stem HAVING count(*) > 1")
def q_repeated_stems(spark, sf_dir):
    return benchmark.repeated_stems(benchmark.videos(_listing(spark, sf_dir)))


@query(f"""WITH {STEPS}, s AS (SELECT item, step_id, size, unnest([1, 2, 3, 4]) AS stage FROM steps), f AS (SELECT item, stage, CASE WHEN item % 5 = 1 AND stage = 2 THEN 1 ELSE step_id END AS step_id, CASE WHEN item % 5 = 2 AND step_id = 1 THEN 0 ELSE 1 END AS n
 FROM s WHERE NOT (item % 5 = 3 AND stage = 3) AND NOT (item % 5 = 4 AND stage = 4 AND step_id > 1)),
p AS (SELECT item, stage, count(*) AS n, count(DISTINCT step_id) AS d, count(*) FILTER (WHERE stage = 4 AND n = 0) AS bare FROM f GROUP BY 1, 2),
i AS (SELECT item, count(*) AS k, min(n) AS lo, max(n) AS hi, bool_or(d < n) AS twice, sum(bare) AS bare FROM p GROUP BY item)
SELECT item, concat_ws(',', CASE WHEN k < 4 THEN 'missing_stage' END, CASE WHEN lo <> hi THEN 'step_counts' END, CASE WHEN twice THEN 'repeated_step_id' END, CASE WHEN bare > 0 THEN 'no_actions' END) AS errors FROM i""")
def q_stage_errors(spark, sf_dir):
    s = V.steps(spark, sf_dir).withColumn("stage", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
    k = F.col("item") % 5
    s = s.where(~((k == 3) & (F.col("stage") == 3)) & ~((k == 4) & (F.col("stage") == 4) & (F.col("step_id") > 1)))
    step = F.when((k == 1) & (F.col("stage") == 2), F.lit(1)).otherwise(F.col("step_id"))
    return benchmark.stage_errors(s.select("item", "stage", step.alias("step_id"), F.when((k == 2) & (F.col("step_id") == 1), 0).otherwise(1).alias("n_actions")))


# --- loose text ---


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"a":1}' WHEN 1 THEN '[1,2]' WHEN 2 THEN '{"b":2}' WHEN 3 THEN '{"d":3}' WHEN 4 THEN '[4]' END AS value FROM documents""")
def q_salvaged(spark, sf_dir):
    forms = ['so ```json\n{"a": 1}\n``` it is', " [1, 2] ", 'first {"b": 2} then {"x": 9}', 'see {"c": {"d": 3}} {', "list [4] of", "nothing {here"]
    d = table(spark, sf_dir, "documents")
    said = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select("doc_id", F.to_json(salvage.salvaged(said)).alias("value"))


@query(f"""WITH {STEPS} SELECT item, step_id, CASE step_id % 3 WHEN 0 THEN '' WHEN 1 THEN step_goal || '|a]b|"c"' ELSE '' END AS shown FROM steps""")
def q_candidates(spark, sf_dir):
    s = V.steps(spark, sf_dir)
    asked = F.when(F.col("step_id") % 3 == 0, F.concat(F.lit('Pick ["'), "step_goal", F.lit('"]'))).when(F.col("step_id") % 3 == 1, F.concat(F.lit('Which? Candidate objects: ["'), "step_goal", F.lit('", " a]b ", "\\"c\\"", " "]. More [1].'))).otherwise(F.lit("candidate objects: none"))
    return s.select("item", "step_id", F.array_join(salvage.candidates(asked), "|").alias("shown"))


@query(r"""WITH r AS (SELECT doc_id, list_filter(list_transform(string_split(replace(trim(text, ' '), chr(13), ''), chr(10)), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '^\s*[-*•]\s+', ''), '^\s*[0-9]+\s*[.)、]\s*', ''), '\s+', ' ', 'g'), ' ')), lambda x: x <> '') AS k FROM documents),
e AS (SELECT doc_id, list_transform(k, lambda x: CASE WHEN ends_with(x, '.') THEN x ELSE x || '.' END) AS k FROM r)
SELECT doc_id, coalesce(len(list_distinct(list_transform(k, lambda x: lower(x)))), 0)::INT AS n, k[1] AS first FROM e""")
def q_statements(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", salvage.statements(F.replace("text", F.lit("\r"), F.lit(""))).alias("k"))
    return d.select("doc_id", F.size("k").alias("n"), F.get("k", F.lit(0)).alias("first"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct([lower(p_name), lower(p_brand)] || CASE WHEN p_size % 2 = 0 THEN [lower(p_type)] ELSE [] END)), '|') AS entities FROM part""")
def q_fact_entities(spark, sf_dir):
    fact = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    facts = F.array(fact("Entity", F.col("p_name"), "note", "x"), fact("main_object", F.concat(F.lit(" "), F.upper("p_brand")), "tool", F.lit(" ")), fact(F.when(F.col("p_size") % 2 == 0, "TARGET").otherwise("targets"), F.col("p_type")), fact("agent", F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(salvage.fact_entities(facts)), "|").alias("entities"))


@query("SELECT p_partkey, replace(p_type, ' ', ' ') || '|' || replace(p_name, ' ', '_') AS fields FROM part")
def q_without_underscores(spark, sf_dir):
    m = F.create_map(F.lit("kind"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("clip_relpath"), F.replace("p_name", F.lit(" "), F.lit("_")))
    p = table(spark, sf_dir, "part").select("p_partkey", salvage.without_underscores(m).alias("m"))
    return p.select("p_partkey", F.concat_ws("|", F.col("m")["kind"], F.col("m")["clip_relpath"]).alias("fields"))


@query(f"""WITH {CAUSAL} SELECT item, step_id, CASE step_id % 8 WHEN 0 THEN n WHEN 1 THEN 'the ' || n || '|serves as ' || t || '|friction holds it' WHEN 2 THEN 'The ' || n || '|' || b WHEN 3 THEN t WHEN 4 THEN 'step ' || step_id || '|' || n
WHEN 5 THEN {LOWER_FIRST("('The ' || n)")} WHEN 6 THEN 'do ' || n ELSE '' END AS spans FROM causal""")
def q_required_spans(spark, sf_dir):
    c = V.causal_steps(spark, sf_dir)
    n, t, b = F.col("patient"), F.regexp_extract(F.col("af_eff")[1], "^The (.*) surface is covered", 1), F.regexp_extract(F.col("sp_pre")[1], "^The (.*) tool is near", 1)
    task = F.element_at(F.array(*[F.lit(x) for x in ("Task_10", "Task_04", "Task_01", "Task_13", "Task_18", "Task_11", "Task_20", "Task_99")]), (F.col("step_id") % 8 + 1).cast("int"))
    texts = {"step_goal": n, "patient": F.concat(F.lit("The "), n, F.lit(".")), "affordance_type": F.concat(F.lit("Serves_as_"), t), "mechanism": F.lit("Friction holds it."), "rationale": F.concat(F.lit(" "), t), "flaw_step": F.col("step_id").cast("string"), "recovery_strategy": F.concat(F.lit("do "), n, F.lit("!."))}
    points = {"spatial_preconditions_pts": F.array(F.concat(F.lit("The "), n), F.lit(" "), b), "repair_steps": F.array(n)}
    empty = F.array().cast("array<string>")
    return c.select("item", "step_id", F.array_join(salvage.required_spans(task, lambda k: texts.get(k, F.lit("")), lambda k: points.get(k, empty)), "|").alias("spans"))


# --- rewards and rows for training ---


@query(f"""WITH {QA}, r AS (SELECT sample_id, substr(task_name, 1, 7) AS t, question, answer FROM qa)
SELECT sample_id, t AS task_id, CASE WHEN answer = '' THEN 'empty' WHEN t = 'Task_19' THEN 'disabled' WHEN t IN ('Task_01', 'Task_02', 'Task_06', 'Task_07') THEN 'fact' WHEN t = 'Task_18' THEN 'repair' WHEN t = 'Task_20' THEN 'recovery' ELSE 'unknown' END AS rule FROM r""")
def q_reward_rule(spark, sf_dir):
    return V.qa(spark, sf_dir).select("sample_id", qa.task_id(F.col("task_name")).alias("task_id"), scoring.reward_rule(qa.task_id(F.col("task_name")), F.col("answer")).alias("rule"))


@query("""WITH t AS (SELECT p_partkey, ['Task_01', 'Task_07', 'Task_18', 'Task_20', 'Task_05'][(p_partkey % 5 + 1)::INT] AS t, p_name, p_size FROM part)
SELECT p_partkey, CASE t WHEN 'Task_01' THEN CASE WHEN p_size % 4 = 0 THEN 'missing patient' ELSE 'spatial/precondition: ' || p_name || ' [' || p_name || ', b]' END WHEN 'Task_07' THEN 'affordance/postcondition: ' || p_name || ' [' || p_name || ', b]'
WHEN 'Task_18' THEN 'repair of step ' || p_size WHEN 'Task_20' THEN 'recovery: ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' after c' ELSE '' END ELSE 'unsupported task' END AS fields FROM t""")
def q_reward_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    task = F.element_at(F.array(*[F.lit(x) for x in ("Task_01", "Task_07", "Task_18", "Task_20", "Task_05")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    n, s = F.col("p_name"), F.col("p_size")
    facts = F.concat(F.lit('["'), n, F.lit('", "b"]'))
    raw = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("spatial_preconditions", "spatial_preconditions_pts", "affordance_postconditions", "affordance_postconditions_pts", "step_goal", "patient", "high_level_goal", "bad_plan_steps", "repair_steps", "flaw_step", "flaw_type", "prefix_end_step_id", "failure_reason", "recovery_strategy", "counterfactual_context")]),
        F.array(n, facts, n, facts, n, F.when((s % 4 == 0) & (task == "Task_01"), F.lit("")).otherwise(n), n, facts, facts, s.cast("string"), n, F.lit("2"), n, n, F.when(s % 2 == 0, F.lit("c")).otherwise(F.lit(" "))),
    )
    f = scoring.reward_fields(task, raw)
    p = p.select("p_partkey", task.alias("t"), f.alias("f"), scoring.missing_fields(task, raw).alias("m"))
    facts_ = F.concat(F.lit(" ["), F.array_join(F.from_json(F.col("f")["target_facts"], "array<string>"), ", "), F.lit("]"))
    out = (
        F.when(F.col("t") == "Task_05", "unsupported task")
        .when(F.size("m") > 0, F.concat(F.lit("missing "), F.array_join("m", ", ")))
        .when(F.col("t") == "Task_18", F.concat(F.lit("repair of step "), F.col("f")["flaw_step"]))
        .when(F.col("t") == "Task_20", F.concat(F.lit("recovery: "), F.col("f")["recovery_strategy"], F.coalesce(F.concat(F.lit(" after "), F.col("f")["counterfactual_context"]), F.lit(""))))
        .otherwise(F.concat(F.col("f")["fact_domain"], F.lit("/"), F.col("f")["fact_stage"], F.lit(": "), F.col("f")["target_text"], facts_))
    )
    return p.select("p_partkey", out.alias("fields"))


@query(f"""WITH {QA} SELECT sample_id, sha1(sample_id) AS id, question || ' / ' || answer AS said, '/p/' || conv_id AS item_dir, CASE WHEN turn % 2 = 0 THEN 'k.jpg,' ELSE '' END || 'a.mp4' || CASE WHEN conv_id % 2 = 0 THEN ',b.mp4' ELSE '' END AS evidence_files FROM qa""")
def q_sharegpt(spark, sf_dir):
    rows = V.qa(spark, sf_dir)
    images = F.when(F.col("turn") % 2 == 0, F.array(F.lit("k.jpg"))).otherwise(F.array().cast("array<string>"))
    video = F.when(F.col("conv_id") % 2 == 0, F.lit('["a.mp4", "b.mp4"]')).otherwise(F.lit("a.mp4"))
    entry = rows.select("sample_id", qa.sharegpt("sample_id", "task_name", "question", "answer", images, video, F.concat(F.lit("/p/"), "conv_id", F.lit("/final_plan.json")), F.lit("clip")).alias("e"))
    return entry.select("sample_id", "e.id", F.concat_ws(" / ", F.col("e.conversations")[0]["value"], F.col("e.conversations")[1]["value"]).alias("said"), "e.meta.item_dir", F.array_join("e.meta.evidence_files", ",").alias("evidence_files"))


@query(f"""WITH {QA} SELECT sample_id, task_name, CASE WHEN conv_id % 2 = 0 THEN 'ACCEPT' ELSE 'REJECT' END AS decision FROM qa""")
def q_filter_meta(spark, sf_dir):
    rows = V.qa(spark, sf_dir).withColumn("meta", F.create_map(F.lit("task_name"), F.col("task_name"), F.lit("filter"), F.lit("old")))
    m = qa.with_meta(F.col("meta"), "filter", F.when(F.col("conv_id") % 2 == 0, "ACCEPT").otherwise("REJECT"))
    return rows.select("sample_id", m["task_name"].alias("task_name"), m["filter"].alias("decision"))


# --- samples normalised from JSON ---


def _samples(spark, sf_dir):
    """Rows in the aliases that samples come in."""
    r = V.qa(spark, sf_dir)
    k = F.col("conv_id") % 4
    q = lambda c: F.to_json(F.struct(c.alias("x")))
    s = lambda c: F.regexp_replace(F.regexp_replace(q(c), r'^\{"x":', ""), r"\}$", "")
    body = (
        F.when(k == 0, F.concat(F.lit('"id": '), s(F.col("sample_id")), F.lit(', "question": '), s(F.col("question")), F.lit(', "answer": '), s(F.col("answer")), F.lit(', "image": "i.jpg"')))
        .when(k == 1, F.concat(F.lit('"sample_id": '), s(F.col("sample_id")), F.lit(', "messages": [{"role": "User", "content": '), s(F.col("question")), F.lit('}, {"role": "assistant", "content": '), s(F.col("answer")), F.lit('}], "video": ["a.mp4", "b.mp4"]')))
        .when(k == 2, F.concat(F.lit('"prompt": '), s(F.col("question")), F.lit(', "output": '), s(F.col("answer")), F.lit(', "meta": {"task_name": "Task_07_X", "video": [{"path": "p.mp4"}], "evidence_type": "video_prefix", "action": "turn"}')))
        .otherwise(F.concat(F.lit('"conversations": [{"from": "human", "value": '), s(F.col("question")), F.lit('}, {"from": "gpt", "value": '), s(F.col("answer")), F.lit('}], "videos": "prefix.mp4", "llm_fields": {"step": "s1"}, "step": "other"')))
    )
    raw = F.concat(F.lit("{"), body, F.lit("}"))
    return r.select(F.concat(F.lit("/d/Task_03_Y/data"), F.col("conv_id") % 4, F.lit(".jsonl")).alias("source_file"), F.concat(F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("row_index"), raw.alias("raw"), F.parse_json(raw).alias("row"))


@query(f"""WITH {QA}, r AS (SELECT *, conv_id % 4 AS k, (conv_id * 100 + turn) AS i FROM qa)
SELECT i AS row_index, CASE WHEN k < 2 THEN sample_id ELSE CASE WHEN k = 2 THEN 'Task_07_X' ELSE 'Task_03_Y' END || ':data' || k || '.jsonl:' || i END AS sample_id, CASE WHEN k = 2 THEN 'Task_07_X' ELSE 'Task_03_Y' END AS task_name, question, answer,
CASE k WHEN 0 THEN 'keyframe_single' WHEN 1 THEN 'video_clip_pair' ELSE 'video_prefix' END AS evidence_type, CASE WHEN k = 0 THEN 'i.jpg' ELSE '' END AS images, CASE k WHEN 0 THEN '' WHEN 1 THEN 'a.mp4,b.mp4' WHEN 2 THEN 'p.mp4' ELSE 'prefix.mp4' END AS videos,
CASE WHEN k = 2 THEN 'action="turn"' WHEN k = 3 THEN 'step="s1"' ELSE '' END AS step_fields FROM r""")
def q_normalised(spark, sf_dir):
    n = qa.normalised(_samples(spark, sf_dir))
    own = F.map_filter(F.col("fields"), lambda k, v: k.isin("action", "step"))
    shown = F.array_join(F.transform(F.map_entries(own), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return n.select("row_index", "sample_id", "task_name", "question", "answer", "evidence_type", F.array_join("images", ",").alias("images"), F.array_join("videos", ",").alias("videos"), shown.alias("step_fields"))


# --- audits ---


@query(f"""WITH {STEPS}, p AS (SELECT item, list(step_goal ORDER BY step_id) AS g, count(*) AS n, count(DISTINCT step_goal) AS d FROM steps GROUP BY item) SELECT item, CASE WHEN item % 2 = 0 THEN true ELSE n < 2 OR g[n] = g[1] END AS in_order FROM p WHERE n = d""")
def q_ordered_goals(spark, sf_dir):
    g = V.steps(spark, sf_dir).groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_id", "step_goal"))), lambda x: x["step_goal"]).alias("goals")).where("size(array_distinct(goals)) = size(goals)")
    told = F.when(F.col("item") % 2 == 0, F.col("goals")).otherwise(F.reverse("goals"))
    marked = g.withColumn("answer", F.array_join(F.transform(told, lambda x: F.concat(F.lit("<"), F.upper(x), F.lit(">"))), " then ")).withColumn("goals", F.transform("goals", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    return audit.ordered_goals(marked).select("item", "in_order")


@query("SELECT p_partkey, p_size % 3 = 0 AS equal FROM part")
def q_set_equal(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    said = F.when(F.col("p_size") % 3 == 0, F.lit("We need the kettle and the Saucer.")).when(F.col("p_size") % 3 == 1, F.lit("The kettle.")).otherwise(F.lit("kettle, saucer, broom"))
    rows = p.select("p_partkey", said.alias("answer"), F.array(F.lit("kettle"), F.lit("saucer")).alias("wanted"), F.array(*[F.lit(x) for x in ("kettle", "saucer", "broom")]).alias("candidates"))
    return audit.set_equal(rows).select("p_partkey", "equal")


@query(f"WITH {STEPS}, p AS (SELECT item, count(*) AS n, count(DISTINCT step_goal) AS d FROM steps GROUP BY item) SELECT item, item % 3 < 2 AS one_off FROM p WHERE n = d AND n >= 4")
def q_one_off(spark, sf_dir):
    g = V.steps(spark, sf_dir).groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_id", "step_goal"))), lambda x: x["step_goal"]).alias("goals")).where("size(array_distinct(goals)) = size(goals) and size(goals) >= 4")
    at = lambda i: F.get("goals", F.lit(i))
    bad = F.when(F.col("item") % 3 == 0, F.array(at(1), F.lit("else"), at(3))).when(F.col("item") % 3 == 1, F.array(at(1), at(3), at(2))).otherwise(F.array(F.lit("x"), F.lit("y"), at(0)))
    return audit.one_off(g.withColumn("bad", bad)).select("item", "one_off")


@query(f"""WITH {REWARDS}, x AS (SELECT item, step_id, step_goal, next_goal, response, {_TERMS('response')} AS o, {_TERMS('step_goal')} AS s1, {_TERMS('next_goal')} AS s2 FROM rewards),
y AS (SELECT item, step_id, CASE WHEN len(s1) > 0 AND NOT {span_present('step_goal', 'response').replace('(s,', '(s1,').replace('len(s)', 'len(s1)')} THEN step_goal END AS a, CASE WHEN len(s2) > 0 AND NOT {span_present('next_goal', 'response').replace('(s,', '(s2,').replace('len(s)', 'len(s2)')} THEN next_goal END AS b FROM x)
SELECT item, step_id, concat_ws('|', a, b) AS absent FROM y""")
def q_grounded_spans(spark, sf_dir):
    rows = V.rewards(spark, sf_dir).select("item", "step_id", F.col("response").alias("answer"), F.array("step_goal", "next_goal").alias("spans"))
    return audit.grounded_spans(rows).select("item", "step_id", F.array_join("absent", "|").alias("absent"))


@query(f"""WITH {STEPS}, f AS (SELECT DISTINCT item, {listed(generate.FLAWS)}[(size % 5 + 1)::INT] AS flaw FROM steps), a AS (SELECT unnest({listed(generate.FLAWS)}) AS flaw), i AS (SELECT DISTINCT item FROM steps)
SELECT i.item, count(f.flaw) AS have, coalesce(string_agg(a.flaw, ',' ORDER BY a.flaw) FILTER (WHERE f.flaw IS NULL), '') AS missing FROM i JOIN a ON true LEFT JOIN f ON f.item = i.item AND f.flaw = a.flaw GROUP BY i.item""")
def q_flaw_coverage(spark, sf_dir):
    every = F.array(*[F.lit(x) for x in generate.FLAWS])
    rows = V.steps(spark, sf_dir).select("item", F.element_at(every, (F.col("size") % 5 + 1).cast("int")).alias("flaw"))
    return audit.coverage(rows, "item", "flaw", generate.FLAWS).select("item", "have", F.array_join("missing", ",").alias("missing"))


@query(f"WITH {QA} SELECT task_name, count(*) AS total, round(avg(turn % 3), 4) AS avg_images FROM qa GROUP BY task_name")
def q_average_images(spark, sf_dir):
    rows = V.qa(spark, sf_dir).withColumn("n_images", F.col("turn") % 3)
    return rows.groupBy("task_name").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("n_images"), 4).alias("avg_images"))


@query(f"""WITH {STEPS}, p AS (SELECT item, count(*) AS n, item % 7 = 0 AS failed FROM steps GROUP BY item) SELECT count(*) AS plans, count(*) FILTER (WHERE failed) AS failed, round(avg(n) FILTER (WHERE NOT failed), 4) AS steps_per_plan, max(n) FILTER (WHERE NOT failed) AS most_steps FROM p""")
def q_run_counts(spark, sf_dir):
    p = V.steps(spark, sf_dir).groupBy("item").agg(F.count(F.lit(1)).alias("n_steps")).withColumn("failed", F.col("item") % 7 == 0)
    return audit.run_counts(p)


@query(f"WITH {CAUSAL} SELECT item, array_to_string(list_transform(list_sort(list({{'s': m, 'p': p}})), lambda x: x.p), '|') AS entities FROM (SELECT item, lower(n) AS p, min(step_id) AS m FROM causal GROUP BY 1, 2) GROUP BY item")
def q_entities_in_order(spark, sf_dir):
    e = audit.entities(V.causal_steps(spark, sf_dir))
    return e.select("item", F.array_join("entities", "|").alias("entities"))


# --- run state and sinks ---


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*[F.lit(x) for x in ("error", "done", "done_incomplete")]), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.col("user_id").alias("rel_item"), "event_id", status.alias("status"))


@query("SELECT user_id AS rel_item, max(event_id) AS event_id, ['error', 'done', 'done_incomplete'][(max(event_id) % 3 + 1)::INT] AS status FROM events GROUP BY user_id")
def q_last_state(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("place", F.col("event_id"))
    return resume.last_state(log, "rel_item", "place").select("rel_item", "event_id", "status")


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE event_id % 70 = 0) AS malformed, round(count(*) FILTER (WHERE event_id % 70 = 0) / count(*)::DOUBLE, 6) AS rate, count(*) FILTER (WHERE event_id % 70 = 0) / count(*)::DOUBLE > 0.01 AS flagged FROM events")
def q_bad_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 70 == 0, F.lit("{broken")).otherwise(F.lit('{"a": 1}')).alias("raw"))
    return resume.bad_line_rate(lines.withColumn("valid", F.try_parse_json("raw").isNotNull()), "valid").withColumn("rate", F.round("rate", 6))


@query(f"WITH {QA}, l AS (SELECT sample_id, task_name, CASE WHEN answer = '' THEN 'empty_answer' WHEN question = '' THEN 'empty_question' END AS reason FROM qa) SELECT sample_id, task_name, reason FROM l WHERE reason IS NOT NULL")
def q_dead_letters(spark, sf_dir):
    rows = V.qa(spark, sf_dir).withColumn("reason", F.when(F.col("answer") == "", "empty_answer").when(F.col("question") == "", "empty_question"))
    return sinks.dead_letters(rows)[1].select("sample_id", "task_name", "reason")


@query(f"WITH {STEPS} SELECT item, step_id, CASE WHEN size % 3 = 0 THEN 'old.mp4' WHEN size % 3 = 1 THEN 'found' || step_id || '.mp4' END AS video, size % 3 = 1 AS filled FROM steps")
def q_backfilled(spark, sf_dir):
    s = V.steps(spark, sf_dir)
    rows = s.select("item", "step_id", F.when(F.col("size") % 3 == 0, "old.mp4").when(F.col("size") % 3 == 2, F.lit(" ")).alias("video"))
    found = s.where("size % 3 < 2").select("item", "step_id", F.concat(F.lit("found"), "step_id", F.lit(".mp4")).alias("value"))
    return sinks.backfilled(rows, found, ["item", "step_id"], "video")


@query(f"""WITH {STEPS}, a AS (SELECT item, step_id, size FROM steps WHERE size % 2 = 0) SELECT s.item, s.step_id, CASE WHEN a.item IS NULL THEN '' ELSE 'lift,turn' END AS actions, CASE WHEN a.item IS NULL THEN 0 ELSE 2 END AS n_actions FROM steps s LEFT JOIN a ON a.item = s.item AND a.step_id = s.step_id""")
def q_merged_plan(spark, sf_dir):
    s = V.steps(spark, sf_dir)
    acts = s.where("size % 2 = 0").select("item", "step_id", F.explode(F.array(*[F.struct(F.lit(i).alias("atomic_action_id"), F.lit(a).alias("action")) for i, a in ((2, "turn"), (1, "lift"))])).alias("x")).select("item", "step_id", "x.*")
    m = resolve.merged_plan(s.select("item", "step_id"), acts)
    return m.select("item", "step_id", F.coalesce(F.array_join(F.transform("atomic_actions", lambda x: x["action"]), ","), F.lit("")).alias("actions"), "n_actions")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'seg 7' WHEN p_partkey % 3 = 1 THEN '12' ELSE NULL END AS said, CASE WHEN p_partkey % 3 = 0 THEN 7 WHEN p_partkey % 3 = 1 THEN 12 END AS number FROM part")
def q_step_number(spark, sf_dir):
    said = F.when(F.col("p_partkey") % 3 == 0, "seg 7").when(F.col("p_partkey") % 3 == 1, "12")
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("said"), resolve.step_number(said).alias("number"))


# --- words ---


@query(f"""WITH {CAUSAL} SELECT item, step_id, CASE step_id % 3 WHEN 0 THEN 'The ' || n || ' is near the box.' WHEN 1 THEN 'The ' || n || ' is not in contact with the box, lid, and tray.' ELSE 'The ' || n || ' is in place.' END AS sentence FROM causal""")
def q_relation_sentence(spark, sf_dir):
    c, k = V.causal_steps(spark, sf_dir), F.col("step_id") % 3
    objects = F.when(k == 0, F.array("patient", F.lit("box"))).when(k == 1, F.array("patient", F.lit("box"), F.lit("lid"), F.lit("tray"))).otherwise(F.array("patient"))
    said = morph.relation_sentence(F.when(k == 1, "contacting").otherwise("near"), objects, F.when(k == 1, F.lit(False)))
    return c.select("item", "step_id", said.alias("sentence"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS truth FROM documents""")
def q_truth(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(x) for x in (" Yes", "0", "TRUE", "n ", "perhaps")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", morph.truth_of(said).alias("truth"))


@query("SELECT p_partkey, p_name || '.' AS ended FROM part")
def q_ended(spark, sf_dir):
    forms = F.element_at(F.array(F.col("p_name"), F.concat("p_name", F.lit(" .")), F.concat("p_name", F.lit(".!?")), F.concat(F.lit(" "), "p_name", F.lit(". "))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.ended(forms).alias("ended"))


@query("SELECT p_partkey, 'take the ' || p_name AS goal FROM part")
def q_shortened_goal(spark, sf_dir):
    goal = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("take the "), "p_name", F.lit(", then put it away"))).otherwise(F.concat(F.lit("take the "), "p_name", F.lit(", "), F.repeat(F.lit("and more "), F.lit(12)), F.lit("of it")))
    return table(spark, sf_dir, "part").select("p_partkey", text.shortened_goal(goal).alias("goal"))


@query(r"""WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type || ' ' || p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM part), c AS (SELECT *, regexp_replace(s[:80], '_[^_]*$', '') AS back FROM s)
SELECT p_partkey, CASE WHEN length(s) <= 80 THEN s WHEN length(back) > 40 THEN back ELSE trim(s[:80], '_') END AS slug FROM c""")
def q_file_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.file_slug(F.concat_ws(" ", "p_name", F.lit("/"), "p_type", "p_name", "p_type", "p_brand")).alias("slug"))


@query(r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'the cup falls' WHEN 1 THEN 'it is wet' WHEN 2 THEN 'the lid is lost' ELSE 'nothing changes' END AS clause FROM documents""")
def q_counterfactual_clause(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(x) for x in ("What if the cup falls?", "Suppose that it is wet.", "What would happen if the lid is lost??", "nothing changes")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", morph.counterfactual_clause(said).alias("clause"))


@query(r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'It falls. It breaks.' WHEN 1 THEN 'A one. B two. C three. D four.' ELSE 'To recover, lift it.' END AS outcome FROM documents""")
def q_cleaned_outcome(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(x) for x in ("It falls. It breaks. The person should lift it. More.", "A one. B two. C three. D four. E five.", "To recover, lift it.")]), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", morph.cleaned_outcome(said).alias("outcome"))


@query("""WITH k AS (SELECT p_partkey, p_size AS n FROM part) SELECT p_partkey, array_to_string(list_transform([0.12, 0.35, 0.65, 0.88], lambda x: round(greatest(0.05::DOUBLE, least(n - 0.05::DOUBLE, x * n)), 4)::DECIMAL(18,4)::VARCHAR), ',') AS times FROM k""")
def q_trace_times(spark, sf_dir):
    t = media.trace_times(F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(t, lambda x: F.round(x, 4).cast("decimal(18,4)").cast("string")), ",").alias("times"))


@query("""WITH e AS (SELECT p_partkey, p_size + 20 AS n, p_size AS c FROM part),
x AS (SELECT *, list_concat([c], list_concat(flatten(list_transform(range(1, 9), lambda d: [c - d, c + d])), list_transform(range(0, 10), lambda i: round_even(i * (n - 1) / 9.0::DOUBLE, 0)::BIGINT + 1))) AS every FROM e),
y AS (SELECT p_partkey, list_filter(every, lambda i: i >= 1 AND i <= n) AS k FROM x), z AS (SELECT p_partkey, list_filter(k, lambda v, i: list_position(k, v) = i)[:10] AS k FROM y)
SELECT p_partkey, array_to_string(k, ',') AS frames FROM z""")
def q_widened(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    w = media.widened(F.array("p_size"), F.col("p_size") + 20, F.lit(10))
    return p.select("p_partkey", F.array_join(F.transform(w, lambda i: i.cast("string")), ",").alias("frames"))


@query("SELECT p_partkey, substr(sha1('/v/' || p_partkey || ':' || p_size || ':17:50'), 1, 16) AS key, p_size % 10 >= 8 AS black, 'data:image/' || CASE WHEN p_size % 2 = 0 THEN 'jpeg' ELSE 'png' END || ';base64,' || to_base64(encode(p_name)) AS url FROM part")
def q_media_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = media.cache_key(F.concat(F.lit("/v/"), "p_partkey"), F.col("p_size"), F.lit(17), F.lit(50))
    light = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i < F.col("p_size") % 10, F.lit(3.0)).otherwise(F.lit(80.0)))
    url = media.data_url(F.encode("p_name", "utf-8"), F.when(F.col("p_size") % 2 == 0, "a.JPG").otherwise("a.png"))
    return p.select("p_partkey", k.alias("key"), media.mostly_black(light).alias("black"), url.alias("url"))


@query("""WITH s AS (SELECT p_partkey, p_size::DOUBLE AS a, p_size % 3 AS k FROM part), t AS (SELECT p_partkey, unnest([1, 2]) AS step_id, a, k FROM s),
u AS (SELECT *, CASE WHEN step_id = 1 THEN a ELSE a + 10 END AS b, CASE WHEN step_id = 1 THEN CASE k WHEN 0 THEN a + 3 ELSE a END ELSE a + 10 END AS e FROM t)
SELECT p_partkey AS item, step_id, round(CASE WHEN e > b THEN e WHEN step_id = 1 THEN b + 9 ELSE b + 0.01 END, 4)::DOUBLE AS end_sec FROM u""")
def q_repaired_durations(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.explode(F.array(F.lit(1), F.lit(2))).alias("step_id"), F.col("p_size").cast("double").alias("a"))
    first = F.col("step_id") == 1
    start = F.when(first, F.col("a")).otherwise(F.col("a") + 10)
    end = F.when(first & (F.col("a") % 3 == 0), F.col("a") + 3).otherwise(start)
    r = intervals.repaired_durations(p.select("item", "step_id", start.alias("start_sec"), end.alias("end_sec")))
    return r.select("item", "step_id", F.round("end_sec", 4).alias("end_sec"))


@query(f"""WITH {QA}, t AS (SELECT sample_id, conv_id % 3 AS k, question, answer FROM qa) SELECT sample_id, CASE k WHEN 0 THEN answer WHEN 1 THEN question ELSE 'draft' END AS kept FROM t""")
def q_rewrite_cascade(spark, sf_dir):
    rows, k = V.qa(spark, sf_dir), F.col("conv_id") % 3
    return rows.select("sample_id", rewrite.chosen(F.col("answer"), F.col("question"), F.lit("draft"), k == 0, k < 2).alias("kept"))


@query(f"""WITH {TRACES} SELECT sample_id, len(list_filter(['place', 'cause', 'end'], lambda c: (c = 'place' AND (contains(lower(trace), 'the') OR contains(lower(trace), 'der'))) OR (c = 'cause' AND contains(lower(trace), 'ingly')) OR (c = 'end' AND contains(lower(trace), 'xyz'))))::INT AS clusters FROM traces""")
def q_clusters(spark, sf_dir):
    c = trace.covered(F.col("trace"), {"place": ["the", "der"], "cause": ["ingly"], "end": ["xyz"]})
    return V.traces(spark, sf_dir).select("sample_id", F.size(c).alias("clusters"))


@query(f"""WITH {QA} SELECT sample_id, '<think>' || chr(10) || question || chr(10) || '</think>' || chr(10) || chr(10) || answer AS traced, answer AS bare FROM qa""")
def q_trace_wrapped(spark, sf_dir):
    rows = V.qa(spark, sf_dir).withColumn("traced", qa.with_trace(F.col("answer"), F.col("question")))
    return rows.select("sample_id", "traced", qa.without_trace(F.col("traced")).alias("bare"))


@query(f"""WITH {STEPS} SELECT item, step_id, '/v/' || item || '.mp4' AS src, step_id::DOUBLE AS start_sec, 2.0::DOUBLE AS duration, '/o/' || item || '/step_segments/step' || lpad(step_id::VARCHAR, 2, '0') || '.mp4' AS dst FROM steps""")
def q_clip_jobs(spark, sf_dir):
    s = V.steps(spark, sf_dir).select(F.concat(F.lit("/o/"), "item").alias("item"), "step_id", F.concat(F.lit("/v/"), "item", F.lit(".mp4")).alias("source"), F.col("step_id").cast("double").alias("start_sec"), (F.col("step_id") + 2).cast("double").alias("end_sec"))
    j = sinks.clip_jobs(s)
    return j.select(F.regexp_extract("dst", "/o/([0-9]+)/", 1).cast("long").alias("item"), F.regexp_extract("dst", "step([0-9]+)[.]mp4", 1).cast("long").alias("step_id"), "src", "start_sec", "duration", "dst")


@query(f"""WITH {STEPS}, p AS (SELECT DISTINCT item FROM steps) SELECT item FROM p WHERE item % 4 = 0""")
def q_removable(spark, sf_dir):
    p = V.steps(spark, sf_dir).select("item").distinct()
    return sinks.removable(p, p.where("item % 4 <> 0"))


# --- round trips through files ---


def _folder(spark, name):
    import uuid

    from quern.session import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_name, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS brand FROM part")
def q_lines_round_trip(spark, sf_dir):
    """Rows written as JSON lines, half of them appended, and read again strictly."""
    path = _folder(spark, "lines")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("brand"))
    sinks.write_lines(rows.where("p_partkey % 2 = 0"), path)
    sinks.write_lines(rows.where("p_partkey % 2 = 1"), path, "append")
    got = jsonl.read_lines(spark, path).where("valid")
    field = lambda k, kind: F.try_variant_get("row", f"$.{k}", kind).alias(k)
    return got.select(field("p_partkey", "long"), field("p_name", "string"), field("brand", "string"))


@query("SELECT DISTINCT 's' || (event_id % 700) AS sample_id FROM events WHERE event_id % 70 <> 0")
def q_finished_ids(spark, sf_dir):
    path = _folder(spark, "results")
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 70 == 0, F.lit('{"sample_id": ')).otherwise(F.concat(F.lit('{"sample_id": "s'), F.col("event_id") % 700, F.lit('"}')))
    e.select(line.alias("value")).write.text(path)
    return jsonl.finished_ids(spark, path)


@query(f"WITH {QA} SELECT task_name, count(*) AS n, count(*) - 1 AS last_index FROM qa GROUP BY task_name")
def q_task_folders(spark, sf_dir):
    """One data.jsonl for each task folder, found again and numbered line by line."""
    path = _folder(spark, "tasks")
    V.qa(spark, sf_dir).select("task_name", F.to_json(F.struct("sample_id")).alias("value")).repartition("task_name").write.partitionBy("task_name").text(path)
    rows = jsonl.numbered(jsonl.read_lines(spark, path)).withColumn("task_name", F.regexp_extract("source_file", "/task_name=([^/]*)/", 1))
    return rows.groupBy("task_name").agg(F.count(F.lit(1)).alias("n"), F.max("row_index").alias("last_index"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'accepted' ELSE 'rejected' END AS verdict, lang AS task_name FROM documents")
def q_verdict_folders(spark, sf_dir):
    path = _folder(spark, "verdicts")
    sinks.write_verdicts(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("task_name"), (F.col("doc_id") % 3 == 0).alias("accepted")), path)
    return spark.read.json(path).select("doc_id", "verdict", "task_name")


@query(f"WITH {QA}, i AS (SELECT sample_id, CASE WHEN answer = '' THEN 'error' ELSE 'warning' END AS severity FROM qa) SELECT severity, count(*) AS n FROM i GROUP BY severity")
def q_issue_files(spark, sf_dir):
    issues = V.qa(spark, sf_dir).select("sample_id", F.when(F.col("answer") == "", "error").otherwise("warning").alias("severity"))
    errors, warnings, counts = sinks.split_issues(issues)
    both = errors.unionByName(warnings).groupBy("severity").agg(F.count(F.lit(1)).alias("m"))
    return counts.join(both, "severity").where("n = m").select("severity", "n")


@query("SELECT n_name AS name, n_regionkey AS region FROM nation")
def q_json_map(spark, sf_dir):
    """Entries of files that each hold one JSON object."""
    path = _folder(spark, "map")
    n = table(spark, sf_dir, "nation")
    one = n.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.col("n_regionkey").alias("r")))))).alias("value"))
    one.write.partitionBy("n_regionkey").text(path)
    rows = jsonl.read_map(spark, path, "name", "v")
    return rows.select("name", F.variant_get("v", "$.r", "int").alias("region"))


@query(f"WITH {QA}, p AS (SELECT sample_id, CASE WHEN question = '' OR answer = '' THEN NULL ELSE 'Judge: ' || question || ' / ' || answer END AS prompt FROM qa) SELECT sample_id, prompt IS NOT NULL AS sent, CASE WHEN prompt IS NOT NULL THEN length(prompt) % 2 = 0 ELSE false END AS accepted FROM p")
def q_judge_stage(spark, sf_dir):
    """Preflight, one call for each prompt by an offline client, and parsing."""
    rows = V.qa(spark, sf_dir).withColumn("issues", F.array_compact(F.array(F.when(F.col("question") == "", "missing_question"), F.when(F.col("answer") == "", "missing_answer"))))
    prompt = F.concat(F.lit("Judge: "), "question", F.lit(" / "), "answer")
    parse = lambda raw: F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$.ok", "boolean"), F.lit(False))
    spec = judge.FilterSpec(prompt, parse)
    client = lambda: lambda p: '{"ok": true}' if len(p) % 2 == 0 else '{"ok": false}'
    ship(spark)
    out = judge.scored(judge.judged(rows, spec, client), spec)
    return out.select("sample_id", F.col("raw_response").isNotNull().alias("sent"), F.col("score").alias("accepted"))


@query(f"WITH {QA} SELECT sample_id, 'qa_reward_v1' AS schema_id, substr(task_name, 1, 7) AS task_id, answer AS reference FROM qa")
def q_ground_truth(spark, sf_dir):
    built = V.qa(spark, sf_dir).withColumn("video", F.lit("/v/a.mp4"))
    rows = built.select("sample_id", *qa.rl_row("sample_id", "task_name", "question", "answer", "video", "pack"))
    v = F.try_parse_json("reward_model.ground_truth")
    at = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    return rows.select("sample_id", at("schema_id").alias("schema_id"), at("task_id").alias("task_id"), at("reference_answer").alias("reference"))


# --- smaller rules ---


@query("""WITH f AS (SELECT user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id FROM events) SELECT item, md5(string_agg(i || ': ' || (event_id % 1000) || '.' || lpad((event_id % 4 * 25)::VARCHAR, 2, '0') || ' s', chr(10) ORDER BY i)) AS manifest FROM f GROUP BY item""")
def q_manifest_text(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("frame_index"))
    frames = e.select("item", "frame_index", (F.col("event_id") % 1000 + F.col("event_id") % 4 / 4).alias("ts"))
    return evidence.manifest_text(frames).select("item", F.md5("manifest").alias("manifest"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 OR doc_id % 9 = 0 THEN '' WHEN doc_id % 2 = 0 THEN array_to_string(range(1, doc_id % 9 + 1), ',') ELSE (doc_id % 9)::VARCHAR END AS steps FROM documents")
def q_steps_of_file(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    name = F.when(k % 3 == 2, F.lit("/step9/whole.mp4")).otherwise(F.concat(F.lit("/a/prefix_step"), F.lpad((k % 9).cast("string"), 2, "0"), F.lit("_x.mp4")))
    return d.select("doc_id", F.array_join(F.transform(evidence.steps_of_file(name, k % 2 == 0), lambda x: x.cast("string")), ",").alias("steps"))


@query(f"WITH {STEPS} SELECT item, string_agg(step_goal, '|' ORDER BY CASE WHEN step_id % 4 = 0 THEN 0 ELSE step_id END, step_id) AS goals FROM steps GROUP BY item")
def q_step_order(spark, sf_dir):
    s = V.steps(spark, sf_dir)
    said = F.when(F.col("step_id") % 4 == 0, "soon").otherwise(F.col("step_id").cast("string"))
    listed_ = s.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_id", said.alias("said"), "step_goal"))), lambda x: F.struct(x["said"].alias("step_id"), x["step_goal"].alias("goal"))).alias("s"))
    return listed_.select("item", F.array_join(F.transform(evidence.in_step_order(F.col("s")), lambda x: x["goal"]), "|").alias("goals"))


@query(f"""WITH {STEPS} SELECT item, step_id, lower(step_goal) || ' it s done' AS plain, true AS phrase, step_id % 2 = 0 AS word FROM steps""")
def q_keyword_found(spark, sf_dir):
    s = V.steps(spark, sf_dir)
    said = F.concat(F.upper("step_goal"), F.lit("...  it's (done)!"))
    word = F.when(F.col("step_id") % 2 == 0, F.split("step_goal", " ")[0]).otherwise(F.lit("don"))
    return s.select("item", "step_id", salvage.plain_words(said).alias("plain"), salvage.keyword_found(said, F.initcap("step_goal")).alias("phrase"), salvage.keyword_found(said, word).alias("word"))


@query("SELECT p_partkey, p_name || ', ' || p_brand || '!' AS line, replace(lower(p_type), ' ', ' ') AS words FROM part")
def q_one_line(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    said = F.concat(F.lit("\n "), "p_name", F.lit(" ,,\n\t"), "p_brand", F.lit("  !! "))
    return p.select("p_partkey", salvage.one_line(said).alias("line"), salvage.humanised(F.concat(F.lit("obj_"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("__")))).alias("words"))


@query("SELECT doc_id, doc_id % 100 AS k FROM documents")
def q_required_object(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.lit('{"k": '), F.col("doc_id") % 100, F.lit("}"))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nthat is all {}"))).otherwise(F.concat(F.lit("so "), body, F.lit(" it is")))
    return d.select("doc_id", F.variant_get(salvage.required_object(said), "$.k", "long").alias("k"))


@query(f"""WITH {STEPS}, b AS (SELECT item, step_id, 'keep the ' || step_goal || ' dry' AS a, 'hold it in both hands now' AS c FROM steps) SELECT item, step_id, CASE WHEN step_id % 2 = 0 THEN a ELSE c END AS best FROM b""")
def q_best_point(spark, sf_dir):
    s = V.steps(spark, sf_dir)
    points = F.array(F.lit("hold it in both hands now"), F.concat(F.lit("keep the "), "step_goal", F.lit(" dry")))
    return s.select("item", "step_id", morph.best_by_terms(points, F.when(F.col("step_id") % 2 == 0, F.col("step_goal")).otherwise("hold hands with both")).alias("best"))


@query(f"""WITH {TRACES} SELECT sample_id, len(regexp_extract_all(trace, '(?m:^[A-Z][A-Z\\s]{{2,30}}:)')) + len(regexp_extract_all(trace, 'PARAGRAPH\\s*[0-9]')) + CASE WHEN len(regexp_extract_all(trace, '(?m:^[0-9]+\\.\\s)')) >= 5 THEN 1 ELSE 0 END
+ len(regexp_extract_all(trace, '(?im:^(?:Step|Phase|Layer|Stage|Part)\\s*[0-9]+\\s*[:\\-—])')) AS patterns FROM traces""")
def q_template_patterns(spark, sf_dir):
    return V.traces(spark, sf_dir).select("sample_id", trace.template_patterns(F.col("trace")).cast("long").alias("patterns"))


@query("SELECT split_part(lang, '-', 1) AS task_name, count(*) AS rows, count(DISTINCT doc_id) AS ids, min(doc_id) AS first_index FROM documents GROUP BY 1")
def q_benchmark_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("task_name"), F.col("doc_id").alias("sample_id"), F.col("doc_id").alias("sample_index"))
    return benchmark.task_counts(d)


# --- indexes of files ---


@query("""SELECT doc_id AS row_id, CASE WHEN doc_id % 4 = 0 THEN '/g/' || doc_id || '/step01_a.mp4' WHEN doc_id % 3 = 0 THEN '/g/' || doc_id || '/other (1).mp4' END AS found FROM documents""")
def q_glob_first(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id")), F.col("row_id")
    at = lambda name: F.concat(F.lit("/g/"), "row_id", F.lit(name))
    index = _present(d, (k % 4 == 0, at("/step01_b.mp4")), (k % 4 == 0, at("/step01_a.mp4")), (k % 3 == 0, at("/other (1).mp4")), (k % 2 == 0, at("/step011.mp4")), (k % 5 == 0, at("/deep/step01_a.mp4")))
    return resolve.first_matching(d.withColumn("patterns", F.array(at("/step01_*.mp4"), at("/other (?).mp4"))), index).select("row_id", "found")


@query("""SELECT '/p/' || doc_id AS item FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT '/p/' || doc_id || '/a/b' FROM documents WHERE doc_id % 3 = 2""")
def q_plan_files(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id")), F.col("row_id")
    at = lambda name: F.concat(F.lit("/p/"), "row_id", F.lit(name))
    index = _present(d, (k % 3 < 2, at("/final_plan.json")), (k % 2 == 0, at("/draft_plan.json")), (k % 3 > 0, at("/a/b/final_plan.json")))
    return resolve.plan_files(index).select("item")


@query("SELECT o_orderkey AS item, CASE o_orderkey % 4 WHEN 0 THEN 'g' || o_custkey END AS goal FROM orders")
def q_loaded_plans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), "o_custkey")
    said = F.concat(F.lit('{"goal": "g'), "o_custkey", F.when(F.col("item") % 4 == 1, F.lit('"')).otherwise(F.lit('"}')))
    texts = o.where("item % 4 < 3").select("item", F.when(F.col("item") % 4 == 2, F.concat(F.lit("["), said, F.lit("]"))).otherwise(said).alias("text"))
    return resolve.loaded_plans(o.select("item"), texts).select("item", F.try_variant_get("plan", "$.goal", "string").alias("goal"))


@query("""SELECT doc_id AS row_id, CASE WHEN doc_id % 5 = 0 THEN 'm/' || doc_id || '.jpg' WHEN doc_id % 3 = 1 THEN '/b/m/' || doc_id || '.jpg' END AS found FROM documents""")
def q_placed_media(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id")), F.col("row_id")
    name = F.concat(F.lit("m/"), "row_id", F.lit(".jpg"))
    files = _present(d, (k % 5 == 0, name), (k % 3 == 0, F.concat(F.lit("/a/"), name)), (k % 3 == 1, F.concat(F.lit("/b/"), name)))
    sized = files.withColumn("size", F.when(F.startswith("path", F.lit("/a/")), 0).otherwise(9))
    return resolve.placed_media(d.withColumn("media", name), sized, ["/a/", "/b"]).select("row_id", "found")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'take "' || p_name || '" and "' || p_brand || '" now' ELSE 'take "x" now' END AS text FROM part""")
def q_repaired_quotes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    draft = F.concat(F.lit('the "'), "p_name", F.lit('" with "'), "p_brand", F.lit('"'))
    said = F.when(F.col("p_size") % 2 == 0, F.lit('take "it" and "that" now')).otherwise(F.lit('take "x" now'))
    return p.select("p_partkey", resolve.repaired_quotes(said, draft).alias("text"))


@query(f"""WITH {QA}, i AS (SELECT sample_id, task_name, 'empty' AS code, row_number() OVER (PARTITION BY task_name ORDER BY sample_id) AS k FROM qa WHERE answer = '' OR conv_id % 2 = 0) SELECT sample_id, task_name, code FROM i WHERE k <= 2""")
def q_kept_issues(spark, sf_dir):
    i = V.qa(spark, sf_dir).where("answer = '' or conv_id % 2 = 0").select("sample_id", "task_name", F.lit("empty").alias("code"))
    return audit.kept_issues(i, 2).select("sample_id", "task_name", "code")


@query(f"""WITH {QA} SELECT sample_id, CASE WHEN question = '' OR answer = '' THEN 'preflight' WHEN conv_id % 3 = 0 THEN 'runtime' END AS kind FROM qa""")
def q_failure_kinds(spark, sf_dir):
    rows = V.qa(spark, sf_dir).withColumn("issues", F.array_compact(F.array(F.when((F.col("question") == "") | (F.col("answer") == ""), "missing"))))
    fails = F.col("conv_id") % 3 == 0
    rows = rows.withColumns({"raw_response": F.when((F.size("issues") == 0) & ~fails, "{}"), "judge_error": F.when((F.size("issues") == 0) & fails, "error: x")})
    return rows.select("sample_id", judge.failure_kind().alias("kind"))


@query("""WITH t AS (SELECT conv_id, arg_min(trim(text, ' '), turn) FILTER (WHERE role = 'user' AND trim(text, ' ') <> '') AS q, arg_min(trim(text, ' '), turn) FILTER (WHERE role = 'assistant' AND trim(text, ' ') <> '') AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'own' ELSE coalesce(q, '') END AS question, coalesce(a, '') AS answer FROM t""")
def q_trace_question(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    turns = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), F.trim(x["text"]).alias("text"))).alias("turns"))
    return turns.select("conv_id", qa.trace_question(F.when(F.col("conv_id") % 2 == 0, " own "), F.lit(" "), F.col("turns")).alias("x")).select("conv_id", "x.*")


_VAGUE = lambda kind: f"{listed(morph.VAGUE[kind])}[(('0x' || substr(md5('vague:' || g), 1, 12))::BIGINT % {len(morph.VAGUE[kind])} + 1)::INT]"


@query(f"""WITH t AS (SELECT p_partkey, p_partkey % 5 AS k, CASE p_partkey % 5 WHEN 0 THEN 'To carefully stirring, ' WHEN 1 THEN 'Then dicing the ' WHEN 2 THEN 'first gather the ' WHEN 3 THEN 'The person takes ' ELSE 'open the ' END || p_name AS g FROM part)
SELECT p_partkey, CASE WHEN k < 2 THEN {_VAGUE('prepare')} WHEN k = 2 THEN {_VAGUE('organize')} WHEN k = 3 THEN {_VAGUE('none')} ELSE {_VAGUE('handle')} END AS goal FROM t""")
def q_vague_goal(spark, sf_dir):
    heads = F.element_at(F.array(*[F.lit(x) for x in ("To carefully stirring, ", "Then dicing the ", "first gather the ", "The person takes ", "open the ")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", morph.vague_goal(F.concat(heads, "p_name")).alias("goal"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct([p_name] || CASE WHEN p_size % 2 = 0 THEN ['steel_box'] ELSE ['knob'] END)), '|') AS objects FROM part""")
def q_key_object_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    even = F.col("p_size") % 2 == 0
    patients = F.array(F.col("p_name"), F.lit("hand"), F.when(even, F.lit(" steel_box ")).otherwise(F.lit("knob")))
    tokens = F.array(*[F.lit(x) for x in ("box", "lid_open", "ready_to_use", "holdable_part", "robot_arm", "9_lives", "left_hand")])
    made = morph.key_objects(patients, tokens, F.array(F.lit("Robot_Arm"), F.col("p_name")), F.array(F.lit("holdable_part")))
    return p.select("p_partkey", F.array_join(made, "|").alias("objects"))
