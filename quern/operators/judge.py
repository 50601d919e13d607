"""The judge stage: model calls as a column of raw responses, between native preflight and native parsing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_CODES = (400, 401, 403, 404, 422)


@dataclass
class FilterSpec:
    """What is asked and how the response is read: a prompt expression and a parser of the raw column."""

    prompt: Column
    parse: Callable[[Column], Column]


class JudgeError(Exception):
    """A failed call with its status code, if the service gave one."""

    def __init__(self, message: str, code: int | None = None):
        super().__init__(message)
        self.code = code


def with_retries(call: Callable[[str], str], prompt: str, retries: int = 2, wait: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(response, None) or (None, error). Errors of the request stop; others are tried again after 1, 2, 4, 8 seconds at most."""
    for k in range(retries + 1):
        try:
            return call(prompt), None
        except JudgeError as e:
            if e.code in STOP_CODES or k == retries:
                return None, f"{e.code or 'error'}: {e}"
        except Exception as e:  # noqa: BLE001  a row must end as a row, with its error
            if k == retries:
                return None, f"{type(e).__name__}: {e}"
        wait(min(8.0, 2.0**k))
    return None, "no attempt"


def judged(samples: DataFrame, spec: FilterSpec, client: Callable[[], Callable[[str], str]], cache: DataFrame | None = None, concurrency: int = 4) -> DataFrame:
    """samples (issues, ...) with raw_response and judge_error.

    Rows with issues are not sent. Prompts that the cache table (prompt_key, raw_response) knows are
    not sent again, nor is one prompt twice. `client` makes a caller once for each partition;
    `concurrency` partitions call at a time. Write the result before parsing it: calls cost money.
    """
    keyed = samples.withColumn("_prompt", F.when(F.size("issues") == 0, spec.prompt)).withColumn("prompt_key", F.sha2("_prompt", 256))
    wanted = keyed.where("prompt_key is not null").select("prompt_key", "_prompt").dropDuplicates(["prompt_key"])
    known = cache.select("prompt_key", "raw_response").dropDuplicates(["prompt_key"]) if cache is not None else None
    if known is not None:
        wanted = wanted.join(known, "prompt_key", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for b in batches:
            got = [with_retries(ask, p) for p in b["_prompt"]]
            yield pd.DataFrame({"prompt_key": b["prompt_key"], "raw_response": [r for r, _ in got], "judge_error": [e for _, e in got]})

    answers = wanted.repartition(concurrency, "prompt_key").mapInPandas(call, "prompt_key string, raw_response string, judge_error string")
    if known is not None:
        answers = answers.unionByName(known.withColumn("judge_error", F.lit(None).cast("string")))
    return keyed.join(answers, "prompt_key", "left").drop("_prompt")


def scored(judged_rows: DataFrame, spec: FilterSpec) -> DataFrame:
    """Adds `score`, the parsed response; rows with issues or failed calls parse as no response, which scores zero."""
    return judged_rows.withColumn("score", spec.parse(F.coalesce("raw_response", F.lit(""))))


def mock_client(table: dict[str, str] | None = None, default: str = '{"decision": "REJECT"}') -> Callable[[], Callable[[str], str]]:
    """Offline client with fixed answers by prompt."""
    return lambda: lambda prompt: (table or {}).get(prompt, default)


def failure_kind() -> Column:
    """Why a judged row has no response: 'preflight' (never sent), 'runtime' (the call failed), null if it has one."""
    return F.when(F.size("issues") > 0, "preflight").when(F.col("judge_error").isNotNull() | F.col("raw_response").isNull(), "runtime")
