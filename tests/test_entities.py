"""Timelines and related parties against brute force."""
import random
from datetime import date, timedelta

import pytest

from noticeboard.operators.entities import match_names, name_candidates, related, timeline
from noticeboard.plans.dossier import dossier


def world(n=90):
    rng = random.Random(2)
    titles = ["Acme Limited", "ACME Holdings", "100% Pure_Ltd", "x", "Zed\\Co", "Über Wein GmbH", None]
    rows = []
    for i in range(n):
        parties = [p for p in ("Bank", "Tax Office", "A", "B") if rng.random() < .4] + \
            (["Bank"] if i % 3 == 0 else [])            # one party in far more than a third
        rows.append({"id": f"n{i:02d}", "title": rng.choice(titles), "headline": f"h{i}",
                     "date": None if i % 9 == 0 else date(2020, 1, 1) + timedelta(days=rng.randint(0, 30)),
                     "nzbn": "1" if i % 3 else str(i % 5), "company_number": f"C{i % 4}",
                     "significance_score": i % 7, "event_category": "land",
                     "affected_parties": None if i % 11 == 0 else parties + ([None] if i % 2 else [])})
    return rows


ENTITIES = [(1, "1", "C1", "acme"), (2, None, "C1", "x"), (3, "", "", "acme"), (4, None, None, "%"),
            (5, None, None, "0% p"), (6, None, None, "l_m"), (7, None, None, ""), (8, None, None, "zed\\c"),
            (9, None, None, "nobody"), (10, "1", None, None), (11, None, None, "ÜBER"), (12, None, None, "x"),
            (13, None, None, "_"), (14, None, None, "pure\\_"), (15, None, None, "zed\\\\c")]


def like(title, name):
    """ILIKE %name% by hand."""
    import re
    if title is None:
        return False
    out, i = "", 0
    while i < len(name):
        c = name[i]
        if c == "\\" and i + 1 < len(name):
            out += re.escape(name[i + 1])
            i += 1
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        i += 1
    return re.search(out, title.lower().replace("\n", " "), re.S) is not None if name == name.lower() \
        else re.search(out.lower(), title.lower(), re.S) is not None


@pytest.mark.parametrize("k", [3, 40])
def test_timeline(spark, notices, k):
    rows = world()
    entities = spark.createDataFrame(ENTITIES, "entity_id int, nzbn string, company_number string, name string")
    got = {}
    for r in timeline(notices(rows), entities, k).orderBy("entity_id", "rank").collect():
        got.setdefault(r["entity_id"], []).append(r["id"])
    for entity, nzbn, number, name in ENTITIES:
        if nzbn:
            able = [r for r in rows if r["nzbn"] == nzbn]
        elif number:
            able = [r for r in rows if r["company_number"] == number]
        else:
            able = [r for r in rows if name and like(r["title"], name)]
        want = sorted(able, key=lambda r: (r["date"] or date.max, r["id"]))[:k]
        assert got.get(entity, []) == [r["id"] for r in want], (entity, name)


def test_related_parties(spark, notices):
    rows = world()
    table = notices(rows)
    got = {}
    for r in related(table, table.select("id"), 5).orderBy("seed_id", "rank").collect():
        got.setdefault(r["seed_id"], []).append(r["id"])
    names = lambda r: {p for p in r["affected_parties"] or [] if p is not None}
    for seed in rows:
        able = [r for r in rows if r["id"] != seed["id"] and names(r) & names(seed)]
        want = sorted(able, key=lambda r: (-(r["date"] or date.max).toordinal(), r["id"]))[:5]
        assert got.get(seed["id"], []) == [r["id"] for r in want]


def test_dossier_has_every_entity_with_a_timeline(spark, notices):
    entities = spark.createDataFrame(ENTITIES, "entity_id int, nzbn string, company_number string, name string")
    got = dossier(notices(world()), entities).collect()
    assert {r["entity_id"] for r in got} == {1, 2, 3, 4, 5, 6, 10, 11, 12, 13, 14, 15}
    assert all(r["significance"] is not None for r in got)


def test_no_cross_joins(spark, notices):
    entities = spark.createDataFrame(ENTITIES, "entity_id int, nzbn string, company_number string, name string")
    plan = timeline(notices(world()), entities)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_name_candidates_follow_the_matches(spark):
    """Titles that share every three letters with many others: candidates stay near one a name."""
    n = 2000
    titles = spark.range(n).selectExpr("format_string('Customer#%09d', id) AS title")
    names = spark.range(n).selectExpr("format_string('customer#%09d', id) AS name")
    assert name_candidates(titles, names).count() <= 2 * n
    assert match_names(titles, names).filter("lower(title) = name").count() == n


def test_names_of_every_length(spark):
    text = "abcdefghijklmnopqrstuvwxyz0123456789" * 4
    titles = spark.createDataFrame([(text,), (text[5:],), (text[::-1],)], "title string")
    lengths = [0, 1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 63, 64, 65, 140]
    cut = [text[2:2 + n] for n in lengths] + [text[:60] + "%" + text[70:90]]
    names = spark.createDataFrame([(c,) for c in cut], "name string")
    got = {(r["name"], r["title"]) for r in match_names(titles, names).collect()}
    held = lambda name, title: all(part in title for part in name.split("%"))
    assert got == {(c, t["title"]) for c in cut for t in titles.collect() if held(c, t["title"])}
