"""Benchmark items, model settings, and guards of inputs and outputs."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.json import text_at
from quern.functions.text import first_text
from quern.operators.qa import first_question, last_answer, turns_of


def selected_tasks(name: Column, wanted: list[str], exact: bool = True) -> Column:
    """Whether a task is among the wanted ones; all are if none is named. Not exact: it begins with one or holds it."""
    if not wanted:
        return F.lit(True)
    if exact:
        return name.isin(wanted)
    out = F.lit(False)
    for w in wanted:
        out = out | F.startswith(name, F.lit(w)) | F.contains(name, F.lit(w))
    return out


def benchmark_items(lines: DataFrame, split: str, tasks: list[str] | None = None, strict: bool = True) -> DataFrame:
    """(task_name, sample_id, sample_index, question, reference_answer, gold_letter, options, error) of rows (task_name, row_index, row VARIANT).

    split 'mcq': options are a map, the answer a letter A to D; else a question and a reference answer,
    if need be from the conversation. strict: a row with an error raises when it is read.
    """
    v = F.col("row")
    kept = lines.where(selected_tasks(F.col("task_name"), tasks or []))
    sample = first_text(text_at(v, "sample_id"), text_at(v, "id"))
    if split == "mcq":
        options = F.try_variant_get(v, "$.options", "map<string,string>")
        letter = F.upper(text_at(v, "answer"))
        question, reference = text_at(v, "question"), first_text(text_at(v, "answer_text"), text_at(v, "gold_answer"))
        error = F.when(sample == "", "no_id").when(options.isNull(), "no_options").when((question == "") | ~letter.isin("A", "B", "C", "D"), "invalid")
    else:
        turns = turns_of(v)
        question = first_text(text_at(v, "question"), text_at(v, "prompt"), first_question(turns))
        reference = first_text(text_at(v, "reference_answer"), text_at(v, "answer"), last_answer(turns))
        options, letter = F.lit(None).cast("map<string,string>"), F.lit(None).cast("string")
        error = F.when(sample == "", "no_id").when((question == "") | (reference == ""), "invalid")
    out = kept.select("task_name", sample.alias("sample_id"), F.col("row_index").alias("sample_index"), question.alias("question"), reference.alias("reference_answer"), letter.alias("gold_letter"), options.alias("options"), error.alias("error"))
    if strict:
        said = F.concat(F.lit("benchmark row "), F.col("sample_index").cast("string"), F.lit(" of "), F.col("task_name"), F.lit(": "), F.col("error"))
        out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(said).cast("string")))
    return out


def task_counts(items: DataFrame) -> DataFrame:
    """By task: rows, distinct ids, and the first place."""
    return items.groupBy("task_name").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sample_id").alias("ids"), F.min("sample_index").alias("first_index"))


def correct(predicted: Column, gold: Column) -> Column:
    """Whether a letter was given and is the right one."""
    return predicted.isNotNull() & predicted.eqNullSafe(gold)


@dataclass
class ModelSettings:
    alias: str
    model: str
    effort: str | None
    most_tokens: int


def read_registry(path: str) -> dict:
    """Model settings by alias; none if there is no file."""
    return json.loads(Path(path).read_text()) if Path(path).exists() else {"models": {}}


def model_settings(alias: str, registry: dict, effort: str | None = None, most_tokens: int | None = None) -> ModelSettings:
    """Settings of an alias, or of a model by its own name; what the caller gives wins. 900 tokens if nobody says."""
    found = registry.get("models") or {}
    own = found.get(alias) if isinstance(found, dict) else None
    own = own or {"model": alias}
    model = str(own.get("model") or alias).strip()
    said = str((effort if effort is not None else own.get("reasoning_effort")) or "").strip().lower()
    tokens = int(most_tokens if most_tokens is not None else own.get("max_output_tokens", 900))
    if not model or tokens <= 0:
        raise ValueError(f"no usable settings for {alias!r}")
    return ModelSettings(alias, model, None if said in ("", "none", "null") else said, tokens)


def prompt_errors(titles: dict[str, str], prompts: dict[str, str]) -> list[str]:
    """What is wrong with a set of prompts: keys that differ from the titles', blanks, Han characters."""
    out = [f"{k}: no prompt" for k in sorted(titles.keys() - prompts.keys())] + [f"{k}: no title" for k in sorted(prompts.keys() - titles.keys())]
    han = lambda t: any("㐀" <= c <= "䶿" or "一" <= c <= "鿿" or "豈" <= c <= "﫿" for c in t)
    return out + [f"{k}: empty" for k, t in sorted(prompts.items()) if not t.strip()] + [f"{k}: Han characters" for k, t in sorted(prompts.items()) if han(t)]


def videos(files: DataFrame, kinds: tuple[str, ...] = ("mp4", "mov", "mkv", "avi", "webm")) -> DataFrame:
    """(path, stem) of a listing (path, real): video files that are not hidden, once for each file they really are, by path."""
    name = F.element_at(F.split("path", "/"), -1)
    shown = files.where(~F.col("path").rlike(r"/\.") & F.lower(name).rlike(r"\.(?:" + "|".join(kinds) + ")$"))
    return shown.groupBy("real").agg(F.min("path").alias("path")).select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("stem"))


def repeated_stems(listed: DataFrame) -> DataFrame:
    """Stems that name two videos or more; a run must not begin with any."""
    return listed.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def stage_errors(steps: DataFrame, stages: int = 4) -> DataFrame:
    """(item, errors) of items whose stage outputs (item, stage, step_id, n_actions) do not fit: stages that are missing,
    step counts that disagree, step ids that repeat, steps of the last stage without actions."""
    per = steps.groupBy("item", "stage").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("step_id").alias("d"), F.count_if((F.col("stage") == stages) & (F.coalesce("n_actions", F.lit(0)) == 0)).alias("bare"))
    out = per.groupBy("item").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low"), F.max("n").alias("high"), F.max((F.col("d") < F.col("n")).cast("int")).alias("twice"), F.sum("bare").alias("bare"))
    codes = F.array_compact(F.array(F.when(F.col("k") < stages, "missing_stage"), F.when(F.col("low") != F.col("high"), "step_counts"), F.when(F.col("twice") == 1, "repeated_step_id"), F.when(F.col("bare") > 0, "no_actions")))
    return out.select("item", F.array_join(codes, ",").alias("errors"))


def write_json(path: str, value: object) -> None:
    """A JSON file of the driver, whole or not at all."""
    part = f"{path}.part"
    with open(part, "w") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def merge_summary(path: str, more: dict) -> dict:
    """A run's summary file with these keys put in; others stay."""
    old = json.loads(Path(path).read_text()) if Path(path).exists() else {}
    write_json(path, new := old | more)
    return new
