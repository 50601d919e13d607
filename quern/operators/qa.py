"""Question-answer rows: normalised samples, preflight, conversion for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import first_text, let, literal_array, uid

USER_ROLES = ["human", "user", "question"]
ASSISTANT_ROLES = ["gpt", "assistant", "model", "answer"]
SFT_ROLES = ["system", "user", "assistant", "tool", "tool_call", "tool_response"]
QUESTION_KEYS = ["question", "prompt", "query", "meta.question"]
ANSWER_KEYS = ["answer", "response", "output", "target", "meta.answer", "meta.reference_answer"]
ID_KEYS = ["id", "sample_id", "meta.id", "meta.sample_id"]
CONTEXT_KEYS = ["source_context", "matched_plan_step", "plan_step", "step", "action", "precondition", "effect", "causal_relation"]
FIELD_KEYS = [
    "task_name", "question_type", "source_context", "plan_step", "step", "step_index", "action", "object", "precondition",
    "effect", "causal_relation", "counterfactual", "answer_rationale", "evidence_type",
]


def string_at(v: Column, path: str) -> Column:
    """A field that is a string, else null."""
    got = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(v, f"$.{path}", "string"))


def turns_of(v: Column) -> Column:
    """Turns as an array of (role, text) from conversations, messages or conversation."""
    kind = "array<struct<from string, role string, value string, content string, text string>>"
    raw = F.coalesce(*[F.from_json(F.to_json(F.try_variant_get(v, f"$.{k}", "variant")), kind) for k in ("conversations", "messages", "conversation")])
    return F.transform(raw, lambda t: F.struct(F.lower(first_text(t["from"], t["role"])).alias("role"), first_text(t["value"], t["content"], t["text"]).alias("text")))


def first_question(turns: Column) -> Column:
    """First text of a user."""
    return F.coalesce(F.get(F.filter(turns, lambda t: t["role"].isin(USER_ROLES) & (t["text"] != "")), F.lit(0))["text"], F.lit(""))


def last_answer(turns: Column) -> Column:
    """Last text of an assistant."""
    return F.coalesce(F.try_element_at(F.filter(turns, lambda t: t["role"].isin(ASSISTANT_ROLES) & (t["text"] != "")), F.lit(-1))["text"], F.lit(""))


def media_of(v: Column, *keys: str) -> Column:
    """Paths of a text, a list of texts, or a list of objects (path, image, video or url), from all keys in turn."""

    def one(path: str) -> Column:
        got = F.try_variant_get(v, f"$.{path}", "variant")
        kind = F.schema_of_variant(got)
        objects = F.transform(F.from_json(F.to_json(got), "array<struct<path string, image string, video string, url string>>"), lambda o: first_text(o["path"], o["image"], o["video"], o["url"]))
        texts = F.try_variant_get(v, f"$.{path}", "array<string>")
        many = F.when(kind.contains("OBJECT"), objects).otherwise(texts)
        return F.when(kind == "STRING", F.array(F.try_variant_get(v, f"$.{path}", "string"))).when(F.startswith(kind, F.lit("ARRAY")), many)

    empty = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(one(p), empty) for k in keys for p in (k,)], *[F.coalesce(one(f"meta.{k}"), empty) for k in keys])
    return F.filter(every, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")


def evidence_type(v: Column, images: Column, videos: Column, raw: Column) -> Column:
    """Explicit, else by the number of videos and words of the row, else by images."""
    said = first_text(*[string_at(v, k) for k in ("evidence_type", "meta.evidence_type", "llm_fields.evidence_type", "meta.qa_evidence_type")])
    low = F.lower(raw)
    return (
        F.when(said != "", said)
        .when(F.size(videos) == 2, F.lit("video_clip_pair"))
        .when((F.size(videos) > 0) & (F.contains(low, F.lit("prefix")) | F.contains(low, F.lit("before"))), F.lit("video_prefix"))
        .when(F.size(videos) > 0, F.lit("video_clip"))
        .when(F.size(images) > 0, F.lit("keyframe_single"))
        .otherwise(F.lit("unknown"))
    )


def merged_fields(v: Column) -> Column:
    """Map of the known fields to their JSON: llm_fields before meta.llm_fields before meta before the row; blanks are dropped."""

    def one(key: str) -> Column:
        tries = [F.to_json(F.try_variant_get(v, f"$.{p}{key}", "variant")) for p in ("llm_fields.", "meta.llm_fields.", "meta.", "")]
        return F.coalesce(*[F.when(~t.isin("null", '""', "[]", "{}"), t) for t in tries])

    return F.map_filter(F.map_from_arrays(literal_array(FIELD_KEYS), F.array(*[one(k) for k in FIELD_KEYS])), lambda k, x: x.isNotNull())


def normalised(lines: DataFrame) -> DataFrame:
    """Samples of (source_file, row_index, row VARIANT, raw): one row for each, with all aliases resolved."""
    v = F.col("row")
    task = first_text(string_at(v, "task_name"), string_at(v, "meta.task_name"), F.regexp_extract("source_file", "(Task[_-][^/]*)/[^/]*$", 1), F.lit("Task_unknown"))
    turns = turns_of(v)
    base = lines.withColumns({"task_name": task, "turns": turns, "images": media_of(v, "image", "images", "image_path"), "videos": media_of(v, "video", "videos", "video_path")})
    return base.select(
        "task_name", "row_index", "source_file",
        first_text(*[string_at(v, k) for k in ID_KEYS], F.concat_ws(":", "task_name", F.element_at(F.split("source_file", "/"), -1), F.col("row_index").cast("string"))).alias("sample_id"),
        first_text(*[string_at(v, k) for k in QUESTION_KEYS], first_question(F.col("turns"))).alias("question"),
        first_text(*[string_at(v, k) for k in ANSWER_KEYS], last_answer(F.col("turns"))).alias("answer"),
        evidence_type(v, F.col("images"), F.col("videos"), F.col("raw")).alias("evidence_type"),
        "images", "videos", merged_fields(v).alias("fields"),
    )


def preflight(question: Column, answer: Column, evidence: Column, images: Column, videos: Column, fields: Column | None = None) -> Column:
    """Issues of a sample in a fixed order."""
    video = evidence.isin("video_clip", "video_prefix", "video_clip_pair")
    issues = [
        F.when(question == "", F.lit("missing_question")),
        F.when(answer == "", F.lit("missing_answer")),
        F.when(evidence == "unknown", F.lit("missing_evidence_type")),
        F.when((evidence == "keyframe_single") & (F.size(images) == 0), F.lit("missing_image_evidence")),
        F.when(video & (F.size(videos) == 0), F.lit("missing_video_evidence")),
    ]
    if fields is not None:
        known = F.exists(F.map_keys(fields), lambda k: k.isin(CONTEXT_KEYS))
        issues.append(F.when(F.size(fields) == 0, F.lit("missing_llm_fields")).when(~known, F.lit("missing_source_context")))
    return F.array_compact(F.array(*issues))


def sft_role(role: Column) -> Column:
    low = F.lower(F.trim(role))
    return F.when(low == "human", F.lit("user")).when(low.isin("gpt", "model"), F.lit("assistant")).when(low.isin(SFT_ROLES), low)


def tag_count(text: Column, tag: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(tag), F.lit("")))) / len(tag)).cast("int")


def with_tags(text: Column, images: Column, videos: Column) -> Column:
    """Text after as many <image> and <video> tags as its media exceed the tags it has."""
    more = F.concat(F.repeat(F.lit("<image>"), F.greatest(F.lit(0), images - tag_count(text, "<image>"))), F.repeat(F.lit("<video>"), F.greatest(F.lit(0), videos - tag_count(text, "<video>"))))
    return F.when(more == "", text).otherwise(F.trim(F.concat(more, F.lit("\n"), text)))


def sft_messages(turns: Column, system: str = "") -> Column:
    """Messages (role, content) of turns (role, text): known roles, no blanks, a system prompt in front if there is none."""
    own = F.filter(F.transform(turns, lambda t: F.struct(sft_role(t["role"]).alias("role"), F.trim(t["text"]).alias("content"))), lambda m: m["role"].isNotNull() & (F.coalesce(m["content"], F.lit("")) != ""))
    if not system.strip():
        return own
    head = F.array(F.struct(F.lit("system").alias("role"), F.lit(system.strip()).alias("content")))
    return let(own, lambda m: F.when(F.exists(m, lambda x: x["role"] == "system"), m).otherwise(F.concat(head, m)))


def tagged_messages(messages: Column, images: Column, videos: Column) -> Column:
    """Messages with missing media tags before the first user text."""

    def made(m: Column) -> Column:
        every = F.array_join(F.transform(m, lambda x: x["content"]), "\n")
        at = F.array_position(F.transform(m, lambda x: x["role"]), "user").cast("int") - 1
        more = F.concat(F.repeat(F.lit("<image>"), F.greatest(F.lit(0), images - tag_count(every, "<image>"))), F.repeat(F.lit("<video>"), F.greatest(F.lit(0), videos - tag_count(every, "<video>"))))
        return F.transform(m, lambda x, i: F.when((i == at) & (more != ""), F.struct(x["role"].alias("role"), F.trim(F.concat(more, F.lit("\n"), x["content"])).alias("content"))).otherwise(x))

    return let(messages, made)


def valid_sft(messages: Column, need_answer: bool = False) -> Column:
    ok = F.exists(messages, lambda m: m["role"] == "user")
    return ok & F.exists(messages, lambda m: m["role"] == "assistant") if need_answer else ok


def lettered(options: Column) -> Column:
    """Lines 'A. text' of an options array; blanks are left out, letters stay with their place."""
    lines = F.transform(options, lambda x, i: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.concat(F.char(F.lit(65) + i), F.lit(". "), F.trim(x))))
    return F.array_join(F.array_compact(lines), "\n")


def lettered_map(options: Column) -> Column:
    """Lines 'key. text' of an options map, by key."""
    entries = F.filter(F.array_sort(F.map_entries(options)), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "")
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(". "), F.trim(e["value"]))), "\n")


def task_id(name: Column) -> Column:
    return F.regexp_extract(F.coalesce(name, F.lit("")), "(Task_[0-9]{2})", 1)


def file_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), F.regexp_replace(F.trim(path), "^file://", ""))


def rewritten(path: Column, prefixes: dict[str, str], substrings: dict[str, str] | None = None) -> Column:
    """The longest prefix that fits is replaced, once; then every substring rule applies."""
    out = path
    for old, new in sorted(prefixes.items(), key=lambda x: len(x[0])):
        out = F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(out)
    for old, new in (substrings or {}).items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def rl_row(sample: str, task: str, question: str, answer: str, video: str, package: str, schema: str = "qa_reward_v1") -> list[Column]:
    """Columns of a reward row: uid, prompt, data_source, reward_model, videos, extra_info."""
    tid, q = task_id(F.col(task)), F.trim(F.regexp_replace(F.coalesce(F.col(question), F.lit("")), r"(?i)<\s*/?\s*video\s*>", ""))
    key = uid(F.lit(package), tid, F.lit(""), F.lit(""), F.col(sample))
    truth = F.to_json(F.struct(F.lit(schema).alias("schema_id"), tid.alias("task_id"), F.trim(F.col(answer)).alias("reference_answer")))
    return [
        key.alias("uid"),
        F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("<video>\n"), q).alias("content"))).alias("prompt"),
        F.lit(package).alias("data_source"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.array(F.struct(file_uri(F.col(video)).alias("video"))).alias("videos"),
        F.struct(tid.alias("task_id"), key.alias("uid"), q.alias("question"), F.trim(F.col(answer)).alias("reference_answer"), file_uri(F.col(video)).alias("video_uri")).alias("extra_info"),
    ]


def rl_errors() -> Column:
    """Errors of a reward row, in order."""
    extra = [F.when(F.coalesce(F.col(f"extra_info.{k}"), F.lit("")) == "", F.lit(f"extra_info.{k} is missing")) for k in ("task_id", "uid", "question", "reference_answer", "video_uri")]
    content = F.col("prompt")[0]["content"]
    return F.array_compact(
        F.array(
            F.when(tag_count(content, "<video>") != 1, F.lit("prompt needs exactly one video")),
            F.when(F.get_json_object("reward_model.ground_truth", "$.task_id") == "", F.lit("unsupported task")),
            F.when(F.size("videos") != 1, F.lit("videos must be one")),
            *extra,
        )
    )


def with_trace(row: Column, trace: Column) -> Column:
    """Answer behind its reasoning trace."""
    return F.concat(F.lit("<think>\n"), F.trim(trace), F.lit("\n</think>\n\n"), F.trim(row))


def without_trace(answer: Column) -> Column:
    return F.trim(F.element_at(F.split(answer, "</think>"), -1), F.lit(" \t\r\n"))


def sharegpt(sample: str, task: str, question: str, answer: str, images: Column, video: Column, source: Column, evidence: Column, attach: bool = True) -> Column:
    """A conversation entry: id, image, video (one, or two given as a JSON list), conversations and meta.

    The id is the sha-1 of the sample's id, where a random one would not repeat. Without `attach` no media are named.
    """
    two = F.from_json(video, "array<string>")
    clips = F.when(F.startswith(F.trim(F.coalesce(video, F.lit(""))), F.lit("[")) & two.isNotNull(), two).when(F.coalesce(video, F.lit("")) != "", F.array(video)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    path = F.trim(F.translate(source, "\\", "/"))
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/+[^/]*$", ""))
    return F.struct(
        F.sha1(sample).alias("id"),
        (images if attach else none).alias("image"),
        (clips if attach else none).alias("video"),
        F.array(turn("human", question), turn("gpt", answer)).alias("conversations"),
        F.struct(F.col(task).alias("task_name"), evidence.alias("evidence_type"), source.alias("source_path"), folder.alias("item_dir"), (F.concat(images, clips) if attach else none).alias("evidence_files")).alias("meta"),
    )


def with_meta(meta: Column, key: str, value: Column) -> Column:
    """A map of texts with one entry put in, in place of an older one."""
    return F.map_concat(F.map_filter(meta, lambda k, v: k != key), F.create_map(F.lit(key), value))


def trace_question(question: Column, answer: Column, turns: Column) -> Column:
    """(question, answer) of a trace's row: its own fields, else the first text of a user and of an assistant."""
    first = F.coalesce(F.get(F.filter(turns, lambda t: t["role"].isin(ASSISTANT_ROLES) & (t["text"] != "")), F.lit(0))["text"], F.lit(""))
    return F.struct(first_text(question, first_question(turns)).alias("question"), first_text(answer, first).alias("answer"))
