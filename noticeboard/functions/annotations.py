"""Validation of annotation answers (JSON text from a pluggable annotator or query parser)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from noticeboard.fixed_values import (ACTION_TYPES, EVENT_CATEGORIES, MAX_PARSED_KEYWORDS)
from noticeboard.functions.text import python_strip


def answer_object(raw: Column) -> Column:
    """The answer as a variant object; null when it is not a JSON object."""
    value = F.try_parse_json(raw)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def _field(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def _kind(value: Column, key: str) -> Column:
    """Variant type name of a field; 'VOID' for a missing or null one."""
    return F.coalesce(F.schema_of_variant(_field(value, key)), F.lit("VOID"))


def _falsy(value: Column, key: str) -> Column:
    """Missing, null, false, zero, empty text, empty list or empty object."""
    as_text = F.coalesce(F.to_json(_field(value, key)), F.lit("null"))
    return as_text.isin("null", "false", '""', "[]", "{}") | \
        F.coalesce(as_text.rlike(r"^-?0+(\.0*)?([eE][-+]?\d+)?$"), F.lit(False))


def text_field(value: Column, key: str) -> Column:
    """Trimmed text, '' for a falsy value, null for anything else (such a row is skipped)."""
    return (F.when(_kind(value, key) == "STRING",
                   python_strip(F.try_variant_get(value, f"$.{key}", "string")))
            .when(_falsy(value, key), F.lit("")))


def coerce_enum(value: Column, allowed: list[str]) -> Column:
    return F.when(value.isin(allowed), value).otherwise(F.lit("other"))


def enum_or_null(value: Column, allowed: list[str]) -> Column:
    return F.when(value.isin(allowed), value)


def _string_field(value: Column, key: str) -> Column:
    return F.when(_kind(value, key) == "STRING", F.try_variant_get(value, f"$.{key}", "string"))


def clamp_score(value: Column) -> Column:
    """0..100; a missing score is 0, a score that is not an integer gives null (row skipped)."""
    missing = F.isnull(_field(value, "significance_score"))
    score = F.try_variant_get(value, "$.significance_score", "int")
    wide = F.try_variant_get(value, "$.significance_score", "double")
    # Numbers beyond the integer range are clamped like all others.
    score = F.coalesce(score, F.when(wide >= 2.0 ** 31, F.lit(100)).when(wide < -2.0 ** 31, F.lit(0)))
    return F.when(missing, F.lit(0)).otherwise(
        F.when(score.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), score))))


def _strings(value: Column, key: str) -> Column:
    """The top-level strings of a list field, in order; null where the field is no list."""
    items = F.try_variant_get(value, f"$.{key}", "array<variant>")
    return F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"),
                       lambda x: F.try_variant_get(x, "$", "string"))


def parties(value: Column) -> Column:
    """Names only: numbers, objects and nulls of the list name nobody and must not link notices."""
    return F.coalesce(_strings(value, "affected_parties"), F.array().cast("array<string>"))


def parse_annotation(raw: Column) -> Column:
    """JSON answer -> annotation struct, or null when the row must stay pending."""
    value = answer_object(raw)
    headline, plain, reason = (text_field(value, k) for k in
                               ("headline", "plain_english", "significance_reason"))
    score = clamp_score(value)
    usable = (value.isNotNull() & headline.isNotNull() & plain.isNotNull() & reason.isNotNull()
              & score.isNotNull())
    return F.when(usable, F.struct(
        headline.alias("headline"), plain.alias("plain_english"),
        coerce_enum(_string_field(value, "event_category"), EVENT_CATEGORIES).alias("event_category"),
        coerce_enum(_string_field(value, "action_taken"), ACTION_TYPES).alias("action_taken"),
        parties(value).alias("affected_parties"),
        score.alias("significance_score"), reason.alias("significance_reason")))


def shape_parsed(raw: Column, query: Column) -> Column:
    """Query-parser answer -> what the search relies on. A failed parse means no filters."""
    value = answer_object(raw)
    rewritten = F.nullif(_string_field(value, "semantic_query"), F.lit(""))
    strings = _strings(value, "keywords")
    return F.struct(
        python_strip(F.coalesce(rewritten, query)).alias("semantic_query"),
        enum_or_null(_string_field(value, "event_category"), EVENT_CATEGORIES).alias("event_category"),
        enum_or_null(_string_field(value, "action_taken"), ACTION_TYPES).alias("action_taken"),
        F.coalesce(F.slice(strings, 1, MAX_PARSED_KEYWORDS),
                   F.array().cast("array<string>")).alias("keywords"))


def merge_filter(explicit: Column, inferred: Column) -> Column:
    """Explicit wins; an explicit '' blocks inference and then counts as no filter."""
    return F.nullif(F.coalesce(explicit, inferred), F.lit(""))


def annotator_input(type_: Column, title: Column, text: Column) -> Column:
    """What an annotator reads; a missing value prints as 'None'."""
    none = F.lit("None")
    return F.concat(F.lit("Notice type: "), F.coalesce(type_, none),
                    F.lit("\nCompany/subject: "), F.coalesce(title, none),
                    F.lit("\n\nFull text:\n"), F.coalesce(text, none))
