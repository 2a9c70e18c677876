"""Landed record -> notice row, field by field."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from noticeboard.fixed_values import (COMPANY_NUMBER_PATTERN, NOTICE_NUMBER_PATTERN, NZBN_PATTERN,
                                      RECORDS_PER_PAGE, SOURCE_STAMP)
from noticeboard.functions.text import python_strip


def _first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def notice_id(identifiers: Column) -> Column:
    """Lower-cased notice number of the first identifier that carries one."""
    found = F.transform(identifiers, lambda item: _first_match(item, NOTICE_NUMBER_PATTERN))
    return F.lower(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)))


def type_code(id_: Column) -> Column:
    return F.substring(F.split_part(id_, F.lit("-"), F.lit(2)), 1, 2)


def day(dates: Column) -> Column:
    """First date's day; an unreadable day becomes null instead of failing the load."""
    return F.try_to_date(F.substring(F.get(dates, F.lit(0)), 1, 10), "yyyy-MM-dd")


def bad_day(dates: Column) -> Column:
    """A date was given but is unreadable; counted by the load."""
    given = F.get(dates, F.lit(0))
    return given.isNotNull() & (given != "") & day(dates).isNull()


def plain_text(value: Column) -> Column:
    """List-or-string field to text: first list item, the string itself, or ''."""
    is_list = F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))
    return F.coalesce(F.when(is_list, F.try_variant_get(value, "$[0]", "string"))
                      .otherwise(F.try_variant_get(value, "$", "string")), F.lit(""))


def body(fulltext: Column, description: Column) -> Column:
    """Full text, or the description where the full text is missing or empty."""
    return F.coalesce(F.nullif(fulltext, F.lit("")), description, F.lit(""))


def nzbn(text: Column) -> Column:
    return _first_match(text, NZBN_PATTERN)


def company_number(text: Column) -> Column:
    return python_strip(_first_match(text, COMPANY_NUMBER_PATTERN))


def source_stamp() -> Column:
    return F.lit(SOURCE_STAMP)


def page_count(result_count: Column, per_page: int = RECORDS_PER_PAGE) -> Column:
    return F.greatest(F.lit(1), F.ceil(result_count / F.lit(per_page)).cast("int"))


def live_edge(results: Column, per_page: int = RECORDS_PER_PAGE) -> Column:
    """A short page is where tomorrow's records land, so it is read again next run."""
    return F.size(results) < per_page
