"""Cross-tokenizer alignment against a plain version: set intersection of offsets, all pairs listed."""
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from noticeboard.llm import op13_alignment as op13

DOCS = "doc_id long, text string, n_a string"


def plain(rows):
    """rows: [(doc_id, text)] -> {row index: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha)}."""
    v = op13.vocabularies(op13.A_VOCAB, op13.B_MODEL)
    per = {}
    for r, (d, t) in enumerate(rows):
        if not t:
            per[r] = (d, None)
            continue
        a = v.a.encode(" " + t, add_special_tokens=False).ids
        b = v.b.encode(t)
        whole = (" " + t).encode()
        if b"".join(v.a_bytes[i] for i in a) != whole or b"".join(v.b_bytes[i] for i in b) != whole:
            per[r] = (d, None)
            continue
        ea, eb, x = [], [], 0
        for i in a:
            x += len(v.a_bytes[i]); ea.append(x)
        x = 0
        for i in b:
            x += len(v.b_bytes[i]); eb.append(x)
        cuts = sorted(set(ea) & set(eb))
        groups, lo = [], 0
        for c in cuts:
            ga = [a[k] for k, e in enumerate(ea) if lo < e <= c]
            gb = [b[k] for k, e in enumerate(eb) if lo < e <= c]
            groups.append((ga, gb))
            lo = c
        links = [(p, q) for ga, gb in groups for p in ga for q in gb]
        per[r] = (d, (len(a), len(b), groups, links))
    count = Counter(pair for _, got in per.values() if got for pair in set(got[3]))
    best = defaultdict(int)
    for (p, _), c in count.items():
        best[p] = max(best[p], c)
    out = {}
    for r, (d, got) in per.items():
        if got is None:
            out[r] = (d, 0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, groups, links = got
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out[r] = (d, n_a, n_b, len(groups), len(links), sum(count[l] == best[l[0]] for l in links),
                  sum(count[l] for l in links), hashlib.sha256(text.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], DOCS)
    got = op13.align(df).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_equals_plain_version(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()[:60]
    odd = [None, "", " ", "a", "  two  spaces", "<|endoftext|> and </s> <s>", "日本語のテキスト", "emoji 🙂🙃 mix",
           "tabs\tand\nlines\r\n", "▁ mark ▁▁", "x" * 3000, "ünïcödé wörds", "12345 67890"]
    rows = [(i, t) for i, t in enumerate(texts + odd)] + [(None, "null id"), (None, "null id"), (3, texts[3])]
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert op13.align(spark.createDataFrame([], DOCS)).count() == 0


def test_gallop_intersect_agrees_with_sets():
    rng = np.random.default_rng(3)
    for n, m in [(0, 5), (5, 0), (1, 1), (50, 3000), (700, 900), (3000, 40)]:
        s = np.unique(rng.integers(0, 5000, n))
        t = np.unique(rng.integers(0, 5000, m))
        i, j = op13.gallop_intersect(s, t)
        assert (s[i] == t[j]).all() and sorted(s[i].tolist()) == sorted(set(s.tolist()) & set(t.tolist()))


def test_groups_text_by_endings():
    import numpy as np
    from noticeboard.llm.op13_alignment import groups_text
    names = [f"{i}{end}" for end in ",|;" for i in range(10)]
    a, b = np.array([1, 2, 3]), np.array([4, 5, 6, 7])
    assert groups_text(a, b, np.array([2, 1]), np.array([1, 3]), names) == "1,2|4;3|5,6,7"


def test_units_are_encoded_once_and_join_to_the_whole():
    """Texts are cut in front of spaces: ids as of whole texts, and a word met before is not encoded again."""
    import random

    import pyarrow as pa
    v = op13.Vocabularies(op13.A_VOCAB, op13.B_MODEL)
    asked, encode = [], v.b.encode
    v.b.encode = lambda x, **more: (asked.append(x if isinstance(x, str) else "".join(x)), encode(x, **more))[1]
    words = pa.array(["the cat sat on the mat " * 500 + str(i) for i in range(9)])
    assert [len(b) for _, b in v.encoded(words)] == [len(encode(t)) for t in words.to_pylist()]
    assert sum(map(len, asked)) < 100
    rng = random.Random(1)
    some = [" "] * 6 + ["\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "　", "​", "a", "the", "'s", "'", "12", ";\r", "▁", "▁",
                        "é", "é", "日", "🙂", "<|endoftext|>", "</s>", "<0x41>", "\x00", "_", "-", "﻿", "́"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(1, 14))) for _ in range(4000)]

    def whole(t):
        a, b, raw = v.a.encode(" " + t, add_special_tokens=False).ids, encode(t), (" " + t).encode()
        same = b"".join(v.a_bytes[i] for i in a) == raw == b"".join(v.b_bytes[i] for i in b)
        return (a, b) if same else ([], [])
    for cuts in (True, False):
        v.cuts = cuts
        v._forget()
        assert [(a.tolist(), b.tolist()) for a, b in v.encoded(pa.array(texts))] == [whole(t) for t in texts]


def test_units_are_forgotten(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(op13, "KNOWN_UNITS", 5)
    v = op13.Vocabularies(op13.A_VOCAB, op13.B_MODEL)
    texts = [f"text {i} of {i + 1} words" for i in range(6)]
    got = [(a.tolist(), b.tolist()) for _ in (1, 2) for t in texts for a, b in v.encoded(pa.array([t]))]
    assert got == [(v.a.encode(" " + t, add_special_tokens=False).ids, v.b.encode(t)) for t in texts] * 2
    assert len(v.slots) <= 5 + 5


def test_links_listed_or_counted_alike(monkeypatch):
    rng = np.random.default_rng(5)
    ga, gb = rng.integers(1, 4, 40), rng.integers(1, 4, 40)
    a, b = rng.integers(0, 6, ga.sum()).astype(np.int64), rng.integers(0, 6, gb.sum()).astype(np.int64)
    listed = op13.links_of(a, b, ga, gb)
    monkeypatch.setattr(op13, "FEW_LINKS", 0)
    assert all((x == y).all() for x, y in zip(listed, op13.links_of(a, b, ga, gb)))
    want, at_a, at_b = Counter(), np.cumsum(ga) - ga, np.cumsum(gb) - gb
    for p, m, q, n in zip(at_a, ga, at_b, gb):
        want.update((int(x), int(y)) for x in a[p:p + m] for y in b[q:q + n])
    assert {(int(x), int(y)): int(n) for x, y, n in zip(*listed)} == want
