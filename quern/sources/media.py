"""Sampling arithmetic for videos and frames. Decoding itself is left to a function of the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import uniform_index

# Frames of evidence by type, and places of a trace's samples.
EVIDENCE_FRAMES = {"keyframe_single": 1, "video_clip": 50, "video_prefix": 100, "video_clip_pair": 100}
TRACE_PLACES = (0.12, 0.35, 0.65, 0.88)


def sample_indices(frames: Column, wanted: Column) -> Column:
    """Frame numbers from 1, spread evenly."""
    return F.transform(uniform_index(frames, wanted), lambda i: i + 1)


def trace_times(duration: Column) -> Column:
    """Four times of a clip, kept 0.05 s off its ends."""
    return F.transform(F.array(*[F.lit(x) for x in TRACE_PLACES]), lambda x: F.greatest(F.lit(0.05), F.least(duration - 0.05, x * duration)))


def widened(critical: Column, frames: Column, most: Column, reach: int = 8) -> Column:
    """Critical frames, then their neighbours by distance, then evenly spread ones: distinct, `most` at most."""
    near = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda d: F.flatten(F.transform(critical, lambda c: F.array(c - d, c + d)))))
    every = F.concat(critical, near, sample_indices(frames, most))
    return F.slice(F.array_distinct(F.filter(every, lambda i: i.between(1, frames))), F.lit(1), most)


def cache_key(path: Column, size: Column, modified: Column, frames: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", path, size.cast("string"), modified.cast("string"), frames.cast("string"))), 1, 16)


def mostly_black(brightness: Column, dark: float = 10.0, share: float = 0.8) -> Column:
    """At least a share of the frames' mean brightnesses is dark."""
    return F.size(F.filter(brightness, lambda b: b < dark)) >= share * F.size(brightness)


def data_url(content: Column, name: Column) -> Column:
    """Image bytes as a data URL with a type guessed from the name."""
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    mime = F.when(kind.isin("jpg", "jpeg"), "image/jpeg").when(kind.isin("png", "gif", "webp", "bmp"), F.concat(F.lit("image/"), kind)).otherwise("application/octet-stream")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def decoded(jobs: DataFrame, decode: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Frames of jobs by the caller's decoder, a batch of rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield decode(b)

    return jobs.mapInPandas(run, schema)
