"""Column expressions against worked examples."""
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from noticeboard.functions import annotations as A, clients as C, records as R, scoring as S, text as T


def one(spark, column, **values):
    schema = ", ".join(f"`{k}` {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("given, want", [
    (["Notice Number: 2000-al123", "Issue Number: 5"], "2000-al123"),
    (["Issue Number: 5", "notice number: 2001-AL9"], "2001-al9"),
    (["Issue Number: 5"], None), ([], None), (None, None)])
def test_notice_id(spark, given, want):
    assert one(spark, R.notice_id(F.col("x")), x=("array<string>", given)) == want


def test_type_code(spark):
    assert one(spark, R.type_code(F.lit("2000-al123"))) == "al"


@pytest.mark.parametrize("given, want", [
    (["2015-06-11 12:00:00 UTC"], date(2015, 6, 11)), (["2025-10-14T00:00:00Z"], date(2025, 10, 14)),
    ([], None), (None, None), (["soon"], None)])
def test_day(spark, given, want):
    assert one(spark, R.day(F.col("x")), x=("array<string>", given)) == want


@pytest.mark.parametrize("given, want", [
    ('["Notice of"]', "Notice of"), ('"Notice of"', "Notice of"), ("null", ""), ("[]", "")])
def test_plain_text(spark, given, want):
    assert one(spark, R.plain_text(F.parse_json(F.lit(given)))) == want
    assert one(spark, R.plain_text(F.lit(None).cast("variant"))) == ""


@pytest.mark.parametrize("given, nzbn, number", [
    ("NZBN 9429041234567", "9429041234567", None),
    ("nzbns: 94290412345678", "9429041234567", None),
    ("Company No.: WN. 327693 was", None, "WN. 327693"),
    ("company number 1234567", None, "1234567"),
    ("Company Number: AK123", None, "AK123"), ("none", None, None)])
def test_entity_keys(spark, given, nzbn, number):
    assert one(spark, R.nzbn(F.lit(given))) == nzbn
    assert one(spark, R.company_number(F.lit(given))) == number


def test_body_falls_through_empty_text(spark):
    assert one(spark, R.body(F.lit(""), F.lit("d"))) == "d"
    assert one(spark, R.body(F.lit("t"), F.lit("d"))) == "t"


@pytest.mark.parametrize("count, pages", [(0, 1), (100, 1), (101, 2), (9277, 93)])
def test_page_count(spark, count, pages):
    assert one(spark, R.page_count(F.lit(count))) == pages


def test_phrases_need_adjacent_whole_words(spark):
    bulk = "BAY RADIATORS LIMITED, X PLUMBING SERVICES LIMITED"
    match = lambda q: one(spark, T.phrase_match(T.tokens(F.lit("Removal of"), F.lit(bulk)), q))
    assert match("bay radiators limited") and match("x plumbing") and match("of bay")
    assert not match("Bay Plumbing Limited") and not match("bay radiator") and not match(" -- ")


def test_phrase_count_overlaps(spark):
    def count(text, phrase):
        words = T.words(F.lit(phrase))
        return one(spark, T.phrase_count(T.spaced(T.words(F.lit(text))), T.spaced(words),
                                         T.overlaps_itself(words)))
    assert count("a a a", "a a") == 2
    assert count("a b a b a", "a b a") == 2
    assert count("a b a b a", "a b") == 2
    assert count("a a a", "a") == 3
    assert count("b", "a") == 0


def test_keyword_phrases(spark):
    got = one(spark, T.phrases(F.array(F.lit('Hawkes "Bay"'), F.lit(' " '), F.lit("wine"))))
    assert got == [["hawkes", "bay"], ["wine"]]
    assert not one(spark, T.any_phrase(F.array(F.lit("a")), F.array().cast("array<array<string>>")))


@pytest.mark.parametrize("query, sentence", [
    ("Bay Radiators Limited", False), ("  a b\tc ", False), ("one two three four", True), ("", False)])
def test_routing(spark, query, sentence):
    assert one(spark, T.is_sentence(F.lit(query))) is sentence


@pytest.mark.parametrize("given, want", [
    ("# Title\n**bold** and `code`\n---\nend", "Title\nbold and code\n\nend"),
    ("answer <tool_call x", "answer"), ("a DSML b invoke name=", "a"), ("", ""), (None, ""),
    ("x ___ y", "x _ y"), ("  text  ", "text")])
def test_strip_markup(spark, given, want):
    got = one(spark, T.strip_markup(F.col("x")), x=("string", given))
    assert got == want


def test_leaked(spark):
    assert one(spark, T.leaked(F.lit("see ｜tool"))) and not one(spark, T.leaked(F.lit("plain")))


def annotation(spark, raw):
    got = one(spark, A.parse_annotation(F.col("x")), x=("string", raw))
    return got and got.asDict()


@pytest.mark.parametrize("raw", [
    None, "garbage", "[1]", '"text"', '{"significance_score": null}', '{"significance_score": "7.5"}',
    '{"significance_score": [1]}', '{"headline": 5}', '{"plain_english": ["x"]}'])
def test_unusable_answers_stay_pending(spark, raw):
    assert annotation(spark, raw) is None


def test_empty_answer_gets_defaults(spark):
    assert annotation(spark, "{}") == {
        "headline": "", "plain_english": "", "event_category": "other", "action_taken": "other",
        "affected_parties": [], "significance_score": 0, "significance_reason": ""}


@pytest.mark.parametrize("score, want", [(75, 75), ("75", 75), (75.9, 75), (-3, 0), (400, 100), (True, 1)])
def test_score_clamp(spark, score, want):
    assert annotation(spark, json.dumps({"significance_score": score}))["significance_score"] == want


def test_answer_fields(spark):
    got = annotation(spark, json.dumps({
        "headline": "  h ", "plain_english": None, "event_category": "land",
        "action_taken": "unknown", "affected_parties": "x", "significance_reason": False}))
    assert (got["headline"], got["plain_english"], got["event_category"], got["action_taken"],
            got["affected_parties"], got["significance_reason"]) == ("h", "", "land", "other", [], "")


def test_only_strings_name_parties(spark):
    got = annotation(spark, json.dumps({"affected_parties": [1, {"a": 1}, "B", None, ["C"], "D"]}))
    assert got["affected_parties"] == ["B", "D"]


def test_parsed_query_shape(spark):
    raw = json.dumps({"semantic_query": "", "event_category": "other thing", "action_taken": "rule_made",
                      "keywords": ["a", 1, None, "b", "c", "d", "e"]})
    got = one(spark, A.shape_parsed(F.col("x"), F.lit(" text ")), x=("string", raw))
    assert (got.semantic_query, got.event_category, got.action_taken, got.keywords) == (
        "text", None, "rule_made", ["a", "b", "c", "d"])
    failed = one(spark, A.shape_parsed(F.col("x"), F.lit("q")), x=("string", "no json"))
    assert (failed.semantic_query, failed.event_category, failed.keywords) == ("q", None, [])


@pytest.mark.parametrize("explicit, inferred, want", [
    (None, "land", "land"), ("claim", "land", "claim"), ("", "land", None), (None, None, None)])
def test_filter_merge(spark, explicit, inferred, want):
    assert one(spark, A.merge_filter(F.col("x"), F.col("y")),
               x=("string", explicit), y=("string", inferred)) == want


@pytest.mark.parametrize("forwarded, peer, want", [
    ("1.1.1.1, 2.2.2.2", "3", "1.1.1.1"), ("", "3", "3"), (None, None, "unknown"), (" , 2", "3", "")])
def test_client_ip(spark, forwarded, peer, want):
    assert one(spark, C.client_ip(F.col("x"), F.col("y")),
               x=("string", forwarded), y=("string", peer)) == want


@pytest.mark.parametrize("ts, want", [
    (datetime(2024, 1, 1), 86400), (datetime(2024, 1, 1, 0, 0, 0, 500000), 86399),
    (datetime(2024, 1, 1, 23, 59, 59, 500000), 1), (datetime(2024, 1, 1, 23, 59, 58), 2)])
def test_retry_after(spark, ts, want):
    at = F.to_timestamp(F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")))
    assert one(spark, C.retry_after(at)) == want


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, S.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.707106781)
    assert one(spark, S.cosine(v(0, 0), v(1, 1))) is None


def test_score_terms(spark):
    import math
    got = one(spark, S.phrase_rank(F.lit(2), F.lit(7)))
    assert got == pytest.approx(0.1 * 1.25 / 1.64493406685 / math.log2(8))
    assert one(spark, S.phrase_rank(F.lit(0), F.lit(7))) == 0
    assert one(spark, S.length_penalty(F.lit(50000))) == 1
    assert one(spark, S.significance_boost(F.lit(None).cast("int"))) == 0
