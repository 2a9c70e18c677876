"""MinHash near duplicates against brute force."""
import random
from itertools import combinations

import pytest

from noticeboard.llm import op2_minhash as op2

SCHEMA = "doc_id long, text string, n_chars string, node string"


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out.append((rows[i][0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = op2.near_duplicates(df).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE\x0btwo"), (905, "one two three"),
            (None, "a null id of some words here"), (906, "a null id of some words here"), (None, "lonely row"),
            (907, "same id one two three four"), (907, "other text under that very id"), (908, "é É x y z")]
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 120, 400]))]
        for copy in range(12):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, len(base) // 30, len(base) // 12])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((100 * family + copy, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd", [32, 3])
def test_equals_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(op2, "CROWD", crowd)
    rows = corpus(crowd)
    assert found(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
