"""JSON objects out of model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(text: Column) -> Column:
    """Response without a code fence around it."""
    s = F.trim(F.coalesce(text, F.lit("")))
    s = F.when(F.startswith(s, F.lit("```")), F.regexp_replace(F.regexp_replace(s, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(s)
    return F.trim(s)


def object_of(text: Column) -> Column:
    """The JSON object of a response as a VARIANT: the whole, else from the first { to the last }.

    Null if there is none. Duplicate keys and NaN count as no JSON.
    """
    s = unfenced(text)
    whole = F.try_parse_json(s)
    inner = F.try_parse_json(F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit("")))
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    return F.when(whole.isNotNull(), F.when(is_object(whole), whole)).when(inner.isNotNull(), F.when(is_object(inner), inner))


def kind_at(v: Column, key: str) -> Column:
    """Type of a field: STRING, BOOLEAN, BIGINT, DECIMAL(..), ARRAY<..>, OBJECT<..>, VOID; null if missing."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))


def text_at(v: Column, key: str) -> Column:
    """Field as trimmed text; empty for missing, null and false."""
    got = F.try_variant_get(v, f"$.{key}", "string")
    return F.trim(F.coalesce(F.when(kind_at(v, key) == "BOOLEAN", F.when(got == "true", F.lit("True")).otherwise(F.lit(""))).otherwise(got), F.lit("")))


def texts_at(v: Column, *keys: str) -> Column:
    """First non-empty of the fields as an array of non-blank trimmed texts; a single text is one item."""
    found = [
        F.when(
            F.startswith(kind_at(v, k), F.lit("ARRAY")),
            F.filter(F.transform(F.try_variant_get(v, f"$.{k}", "array<string>"), lambda x: F.trim(F.coalesce(x, F.lit("None")))), lambda x: x != ""),
        ).when((kind_at(v, k) == "STRING") & (F.trim(F.try_variant_get(v, f"$.{k}", "string")) != ""), F.array(F.trim(F.try_variant_get(v, f"$.{k}", "string"))))
        for k in keys
    ]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in found], F.array().cast("array<string>"))
