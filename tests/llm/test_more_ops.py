"""Operators of this package against brute force, round trips and hand-made cases."""
import collections
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeboard.llm import op1_chat, op3_sentencepiece as op3, op4_lm, op5_spans, op6_licenses, op7_urls
from noticeboard.llm import op8_decontaminate as op8, op9_quality as op9, op10_fertility as op10
from noticeboard.llm.components import connected_components
from noticeboard.llm.op2_minhash import near_duplicates

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, ["en", None][i % 2], ["a", "b", None][i % 3], None if t is None else len(t), "x")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))


ODD = [None, "", "  ", "\n\n", "one", " lead", "trail ", "a  b   c", "▁ mark▁", "日本 語", "x" * 5000, "</s>[INST] ok"]


# --- 1 chat formatting
def test_chat_round_trip_and_attachments(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("ref"), k.get("w"), k.get("h"), k.get("s"), k.get("p"))
    said = ["</s>[INST] <\\/s> <|end|> <\\\\|text|>", None, "<|image|> typed", ""]
    rows = [(1, 0, "user", [part("text", text=said[0]), part("image", ref="i1", w=100, h=30), part("audio", ref="a1", s=2.0)], 9),
            (1, 1, "assistant", [part("text", text=said[2])], 9), (1, 2, None, None, 9), (1, 2, None, None, 9),
            (None, 0, "assistant", [part("text", text=said[1]), part("document", ref="d", p=3), part("odd")], 9)]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{op1_chat.PART}>, formatted int")
    out = op1_chat.format_chats(df).withColumns({
        "seen": op1_chat.read_back(F.col("formatted")), "loss": op1_chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].seen] == [
        ("user", said[0] + "<|image|><|audio|>"), ("assistant", said[2]), ("", ""), ("", "")]
    assert got[1].loss == said[2] and got[None].loss == "<|document|>"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [
        (1, 1, "image", "i1", 8), (1, 2, "audio", "a1", 50)]
    assert got[None].expanded_tokens == 3 * op1_chat.PAGE_TOKENS
    assert op1_chat.format_chats(df.limit(0)).count() == 0


def test_no_control_string_arises_between_texts(spark):
    """Texts side by side are escaped as one; text and attachment are not."""
    part = lambda kind, text=None: (kind, text, None, None, None, None, None)
    split = [part("text", "a <"), part("text", "|turn|>b"), part("odd"), part("text", None), part("text", "[INST"), part("text", "]"),
             part("image"), part("text", "</"), part("text", "s>")]
    df = spark.createDataFrame([(1, 0, "user", split)], f"conv_id long, turn int, role string, parts array<{op1_chat.PART}>")
    row = op1_chat.format_chats(df).withColumn("seen", op1_chat.read_back(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in row.seen] == [("user", "a <|turn|>b[INST]<|image|></s>")]
    assert row.formatted.count("<|turn|>") == 1 and "[INST]" not in row.formatted and "</s>" not in row.formatted


def test_escape_is_reversible(spark):
    rng = random.Random(5)
    bits = ["<", "[", "\\", "/s>", "INST]", "|end|>", "/INST]", "x", "<|turn|>", "</s>"]
    texts = ["".join(rng.choice(bits) for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", op1_chat.escape(F.col("t")))
    for r in df.withColumn("back", op1_chat.unescape(F.col("e"))).collect():
        assert r.back == r.t and not re.search(r"</?s>|\[/?INST\]|<\|(turn|end)\|>", r.e)


# --- 3 tokens
def textbook(pieces, text):
    """Best segmentation of the whole marked text by a plain forward pass."""
    marked = op3.MARK + text.replace(op3.MARK, op3.OWN_MARK).replace(" ", op3.MARK)
    best = [(0.0, ())]
    for end in range(1, len(marked) + 1):
        char = marked[end - 1]
        raw = (op3.MARK if char == op3.OWN_MARK else " " if char == op3.MARK else char).encode()
        top = (best[end - 1][0] + pieces.fallback, best[end - 1][1] + tuple(pieces.byte_ids[b] for b in raw))
        for begin in range(end - 1, max(-1, end - 20), -1):
            hit = pieces.pieces.get(marked[begin:end])
            if hit and best[begin][0] + hit[1] >= top[0]:
                top = (best[begin][0] + hit[1], best[begin][1] + (hit[0],))
        best.append(top)
    return list(best[-1][1])


def test_encoding_equals_textbook_and_round_trips(spark):
    rng = random.Random(3)
    texts = [t for t in ODD if t != "x" * 5000] + [prose(rng, 40) for _ in range(5)] + ["".join(
        rng.choice("ab ▁é\n<語") for _ in range(rng.randrange(30))) for _ in range(60)]
    pieces = op3.pieces_of(op3.MODEL)
    ids = op3.encode_texts(pa.array(texts)).to_pylist()
    assert ids == [None if t is None else textbook(pieces, t) if t else [] for t in texts]
    out = op3.decode(op3.encode(docs(spark, texts + ["x" * 5000]))).collect()
    assert all(r.decoded == r.text for r in out) and len(out) == len(texts) + 1
    assert op3.encode(docs(spark, [])).count() == 0


# --- 4 language model
def test_lm_base_and_normalisation(spark, monkeypatch):
    monkeypatch.setattr(op4_lm, "COMMON", 30)
    monkeypatch.setattr(op4_lm, "CLASSES", 12)
    rng = random.Random(4)
    texts = [None, "", "A b a", "b\x0bA"] + [prose(rng, rng.randrange(200), 80) for _ in range(60)]
    ids = [None, 1, 1, *range(3, len(texts))]
    tokens = [WORD.findall((t or "").lower()) + ["\n"] for t in texts]
    train = [zlib.crc32(("null" if i is None else str(i)).encode()) % 7 != 2 for i in ids]
    count = collections.Counter(w for t, ok in zip(tokens, train) if ok for w in t)
    total, distinct = sum(count.values()), len(count)
    got = op4_lm.lm_scores(docs(spark, texts, ids)).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[3], round(r[4], 4))
    want = [(i, not ok, len(t), sum(count[w] > 0 for w in t),
             sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t)) for i, ok, t in zip(ids, train, tokens)]
    assert sorted(map(key, want)) == sorted(key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score)) for r in got)
    assert all(r.train_tokens == total and r.score < 0 for r in got)
    assert op4_lm.lm_scores(docs(spark, [])).count() == 0


def test_model_learns_and_is_normalised():
    import numpy as np
    rng = np.random.default_rng(0)
    unigram = np.full(6, 1 / 6)
    triples = np.array([[a, b, (b + 1) % 6] for a in range(6) for b in range(6)])
    model = op4_lm.Model(np.log(unigram))
    for _ in range(300):
        model.train(triples, np.ones(36), unigram, rng)
    p = 10 ** model.log10(triples[:, 0], triples[:, 1])
    assert np.allclose(p.sum(axis=1), 1) and np.log10(p[np.arange(36), triples[:, 2]]).mean() > np.log10(1 / 6) + 0.05


# --- 5 spans
def test_spans_cut_all_but_the_first(spark):
    rng = random.Random(6)
    own = lambda n: ". ".join(" ".join(f"u{rng.randrange(10**6)}" for _ in range(8)) for _ in range(n)) + "."
    passage, line = own(8), "all share this line"
    texts = [f"{line}\n{own(3)} {passage} {own(2)}" for _ in range(6)] + [passage, None, "", f"{own(2)}\n{passage}\n{own(1)} {passage}"]
    got = {r.doc_id: r for r in op5_spans.drop_repeated_spans(docs(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[6].text == "" and got[7].text is None and got[8].text == ""
    for i in (1, 2, 3, 4, 5, 9):
        assert passage not in got[i].text and got[i].text.startswith(texts[i][:19]) and got[i].n_chars == len(got[i].text)
        assert got[i]._n_removed >= 8 and got[i]["word"] == "x"
    twice = [own(2) + "\n" + passage + "\n" + own(2) + "\n" + passage]
    once = op5_spans.drop_repeated_spans(docs(spark, twice)).first()
    assert once.text.count(passage[:60]) == 1
    same = op5_spans.drop_repeated_spans(docs(spark, [passage, passage, passage], [None, None, 4])).collect()
    assert sorted((str(r.doc_id), r.text) for r in same) == [("4", passage), ("None", ""), ("None", "")]
    assert op5_spans.drop_repeated_spans(docs(spark, [])).count() == 0


def test_spans_equal_brute_force():
    rng = random.Random(8)
    texts = [prose(rng, 150, 40) for _ in range(4)]
    spans = op5_spans.Spans(texts)
    words = [len(s.split()) for s in spans.pieces]
    want = set()
    for r in range(4):
        a, b = spans.first[r], spans.first[r + 1]
        enough = lambda i, j: (sum(words[i:j]) >= op5_spans.MIN_WORDS and j - i >= 2) or sum(words[i:j]) >= op5_spans.LONG_WORDS
        for i in range(a, b):
            forward = next((j for j in range(i + 1, b + 1) if enough(i, j)), None)
            back = next((j for j in range(i, a - 1, -1) if enough(j, i + 1)), None)
            want |= {(i, forward)} if forward else set()
            want |= {(back, i + 1)} if back is not None else set()
    assert set(zip(spans.start.tolist(), spans.stop.tolist())) == want
    assert "".join(spans.pieces) == "".join(texts)


# --- 6 licences
def test_licences_and_inheritance(spark):
    rows = [("p/LICENSE", "Released under the MIT License."), ("p/a/x.py", "code"), ("p/b/COPYING", "Licensed under the Apache License, Version 2.0"),
            ("p/b/c/y.py", "no words"), ("p/b/z.py", "text\nThis work is licensed under the GNU General Public License, version 3.\n"),
            ("q/x", "All rights reserved of nothing licence like whatever else this is copyright"), (None, None), ("p", ""), ("p/a/x.py", "code")]
    df = spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, text string, line int")
    got = collections.Counter((r.path, r._license, r._how) for r in op6_licenses.scan_licenses(df).collect())
    assert got == collections.Counter([("p/LICENSE", "MIT", "header"), ("p/a/x.py", "MIT", "inherited"), ("p/a/x.py", "MIT", "inherited"),
                                       ("p/b/COPYING", "Apache-2.0", "header"), ("p/b/c/y.py", "Apache-2.0", "inherited"),
                                       ("p/b/z.py", "GPL-3.0", "header"), ("q/x", None, None), (None, None, None), ("p", None, None)])
    assert op6_licenses.scan_licenses(df.limit(0)).count() == 0


def test_headers_and_licence_bodies(spark):
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
    gpl = """Foo Bar, a tool of the Quux company.
Copyright (C) 2011 Jane Doe

This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version %s of the License, or
(at your option) any later version."""
    code = "\n\nint main() { return foo(bar, baz); }\n" * 30
    commented = lambda text: "".join(f"# {x}\n" for x in text.split("\n")) + code
    rows = [("a/one.c", "// Copyright 2020 The Foo Authors. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
             "use this file except in compliance with the License." + code, "Apache-2.0"),
            ("a/two.c", commented("Copyright 2019 Foo GmbH\n\n" + apache), "Apache-2.0"),
            ("a/three.c", commented(gpl % "3"), "GPL-3.0"), ("a/four.c", "/* " + gpl % "2" + " */" + code, "GPL-2.0"),
            ("a/five.c", "/* Mozilla Public License Version 2.0 */" + code, "MPL-2.0"),
            ("a/six.c", "Copyright 2020 MIT researchers" + code, None),
            ("a/seven.c", "Copyright 2020 Foo. All rights reserved." + code, "Proprietary")]
    folder = op6_licenses.Path(op6_licenses.__file__).with_name("licenses")
    for p in sorted(folder.glob("*.txt")):
        body = p.read_text().replace("Copyright (c)", "Copyright (c) 2024 Foo Bar Ltd, All rights reserved.")
        rows += [(f"lib/{p.stem}/LICENSE", body, p.stem), (f"lib/{p.stem}/src/x.py", "x = 1", p.stem),
                 (f"other/{p.stem}.txt", "\r\n".join(body.split("\n")), p.stem)]
    assert len(rows) > 30
    df = spark.createDataFrame([r[:2] for r in rows], "path string, text string")
    got = {r.path: r._license for r in op6_licenses.scan_licenses(df).collect()}
    assert got == {path: want for path, _, want in rows}


# --- 7 urls
def test_url_rules_and_model(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/1?x=1", "http://example.com/en/", "http://a.example.com", "http://xcom/",
            "http://b.NET/es/1#t", "http://net/es/", "http://c.net/de/#x", "x://y://z/q", "http://h?q/en/"]
    urls += [f"http://s{i}.net/fr/{i}" for i in range(40)] + [f"http://t{i}.com/de/{i}" for i in range(40)]
    df = spark.createDataFrame([(u, 1) for u in urls], "url string, host int")
    got = {r.url: (r._host, r._path, r._rule, r._verdict) for r in op7_urls.judge_urls(df).collect()}
    assert got[None][:3] == ("", "", None) and got["no scheme"][:2] == ("", "")
    assert got[urls[3]] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[urls[4]][2:] == ("example.com/en/", "block") and got[urls[5]][:3] == ("a.example.com", "", None)
    assert got[urls[6]][2] is None and got[urls[7]][1:] == ("/es/1", "net/es/", "block") and got[urls[8]][3] == "block"
    assert got["x://y://z/q"][:2] == ("y:", "//z/q") and got["http://h?q/en/"][:2] == ("h", "")
    assert op7_urls.judge_urls(df.limit(0)).count() == 0


def test_url_model_on_unseen_urls(spark):
    label = lambda u: 1.0 if "bad" in u else 0.0
    urls = [f"{a}{i}.org" for i in range(150) for a in ("badshop", "library")]
    data = spark.createDataFrame([(u, "/p", label(u)) for u in urls], "host string, path string, blocked double")
    test = spark.createDataFrame([(f"http://{a}{i}.org/p",) for i in range(900, 960) for a in ("badshop", "library")], "url string")
    out = op7_urls.judge_urls(test, [("allow", "none", "/")], data).collect()
    assert sum((r._verdict == "block") == ("bad" in r.url) for r in out) >= 0.95 * len(out)


# --- 8 benchmark
def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_equals_alignment(spark):
    rng = random.Random(9)
    items = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in (12, 30, 60)]
    texts = []
    for k in range(40):
        text = list(rng.choice(items))
        for _ in range(rng.choice([0, 2, 5, 9, 14, 25])):
            text[rng.randrange(len(text))] = rng.choice("abcdefgh ")
        texts.append(prose(rng, 20) + " " + "".join(text).upper() + "  " + prose(rng, 10))
    texts += ODD + [prose(rng, 60)]
    windows = op8.Windows(list(enumerate(items)))
    want = [sorted({windows.item[w] for w in range(len(windows.text))
                    if distance(windows.text[w], op8.normal(t)) <= windows.budget[w]}) for t in texts]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(7, None, 1), (8, "short", 1)], "item_id long, text string, doc_id int")
    got = {r.doc_id: r._items for r in op8.contaminated(docs(spark, texts), bench).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(map(bool, want)) > 10
    assert op8.contaminated(docs(spark, []), bench).count() == 0
    assert all(not r._items for r in op8.contaminated(docs(spark, texts[:3]), bench.limit(0)).collect())


def test_short_benchmark_items_are_found(spark):
    items = ["What is the capital of Peru?", "Lima", "日本の首都は", "東京", "straße", "ab", "", " ", "née", "7", "nine byte", "Lima"]
    texts = ["so: what  is the\tCAPITAL of peru? tell", "lima", "limas slima lima_ élima limaé", "(Lima)", "質問:日本の首都はどこか", "東京都", "Straße", "Straßen",
             "cab abc x-ab", "nee", "NéE", "née", "77 7a", "x7 7", "nine  byte", "nine bytes", None, "", "what is the capital of peru ?"]
    want = [[0], [1, 11], [], [1, 11], [2], [3], [4], [], [5], [], [8], [8], [], [9], [10], [], [], [], []]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r._items for r in op8.contaminated(docs(spark, texts), bench).collect()}
    assert [got[i] for i in range(len(texts))] == want
    rng = random.Random(4)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    some = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(150)})
    windows = op8.Windows([(k, t) for k, t in enumerate(some) if len(t) < op8.MIN_ITEM])
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(40))
        assert windows.matches(text.encode()) == {k for k, t in enumerate(some) if len(t) < op8.MIN_ITEM and f" {t} " in f" {text} "}


def test_benchmark_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    items = [prose(rng, 30, 5000) for _ in range(30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs(spark, [items[3] + " " + items[4], "clean " + prose(rng, 50)])
    monkeypatch.setattr(op8, "BLOCK_BYTES", 2000)
    assert {r.doc_id: r._items for r in op8.contaminated(df, bench).collect()} == {0: [3, 4], 1: []}


# --- 9 classifier
def test_classifier_on_held_out_rows(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(900):
        kind = rng.choice(["good", "good", "good", "junk", "toxic"])
        words = prose(rng, 60, 3000).split()
        if kind == "toxic":
            words[5:5] = rng.sample(["awfulword", "nastyword", "vileword"], 2)
        if kind == "junk":
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "en", f"s{i % 9}", 0, kind))
        if i < 500:
            labels.append((i, int(kind != "junk"), int(kind == "toxic"), "e"))
    rows += [(5000, None, None, None, 0, "good"), (None, "", "en", "s1", 0, "good")]
    df = spark.createDataFrame(rows, DOCS)
    table = spark.createDataFrame([*labels, (6, None, None, "e"), (None, 1, 0, "e")], "doc_id long, quality int, toxic int, text string")
    out = op9.judged(df, table).collect()
    assert len(out) == len(rows)
    unseen = [r for r in out if r.doc_id is None or r.doc_id >= 500]
    assert sum(r._keep == (r["word"] == "good") for r in unseen) >= 0.98 * len(unseen)
    assert all(r._keep for r in op9.judged(df, table.limit(0)).collect())
    assert op9.judged(df.limit(0), table).count() == 0


# --- 10 fertility
def test_fertility_counts_equal_brute_force(spark):
    import sentencepiece
    rng = random.Random(11)
    texts = ODD + ["a b c a b c d", "x\nx\n \n \nx\t\n", "# $ a|b"] + [prose(rng, 120, 15) for _ in range(10)]
    sp = sentencepiece.SentencePieceProcessor(model_file=op10.MODEL)
    got = {r.doc_id: r for r in op10.quality_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        grams = collections.Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        hit = {k + j for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for j in range(3)}
        lines = (t or "").split("\n")
        again = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
        ids = [x for w in words for x in sp.encode(w)]
        share = collections.Counter(ids)
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in share.values()) if ids else None
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_tokens) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), again, len(hit), len(ids)), (i, t)
        assert r.entropy == pytest.approx(entropy, abs=1e-6) if ids else r.entropy is None
        assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert op10.quality_rules(docs(spark, [])).count() == 0


def test_no_octave_and_no_copies_judge_themselves(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    say = lambda n, of: " ".join(rng.choice(words[:of]) for _ in range(n))
    normal = [say(rng.randrange(60, 900), 3000) for _ in range(240)]
    long_junk, long_good, copied = say(6000, 30), say(6000, 3000), say(300, 12)
    texts = normal + [long_junk] * 2 + [long_good] + [copied] * 400
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(-1, say(6000, 30), "xx"), (-2, say(6000, 3000), "xx")],
                               "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in op10.quality_rules(df).collect()}
    n = len(normal)
    assert [got[n + k].odd_entropy for k in range(3)] == [True, True, False]     # two copies and one text alone in their octaves
    assert all(got[n + 3 + k].odd_entropy for k in range(400))                   # the most rows of their octave, one text
    assert got[-1].odd_entropy and not got[-2].odd_entropy                       # a language of two texts
    assert sum(got[i].odd_entropy for i in range(n)) == 0


# --- helpers and pipeline
def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 20), (5, 4), (30, 31)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 30: 30, 31: 30}


CLASHING = ["_id", "_elsewhere", "span", "owner", "_n_sentences", "_n_removed", "_items", "_evidence", "_p_good", "_keep",
            "_s", "_l", "_good", "class", "good", "_kept", "kept", "node", "ids", "decoded", "_lines", "_dir", "_key",
            "_own", "_up", "_license", "_how", "_cosine", "_host", "_rule", "block", "row", "a.b", "_passed_through_1"]


def test_clashing_names(spark):
    """Columns called like anything inside an operator change no result; those called like an output are replaced."""
    rng = random.Random(3)
    texts = [*ODD, *(prose(rng, 90) for _ in range(10))]
    plain = docs(spark, [*texts, *texts[-3:]])
    labels = spark.createDataFrame([(i, i % 2, 0, 7, 8) for i in range(20)], "doc_id long, quality int, toxic int, class int, good int")
    bench = spark.createDataFrame([(1, texts[-1][:200], 5)], "item_id long, text string, code int")
    wide = plain.withColumns({f"`{c}`" if "." in c else c: F.lit(f"own {c}") for c in CLASHING if "." not in c})
    wide = wide.select("*", F.lit("dotted").alias("a.b"))
    paths = lambda df: df.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    runs = {
        "op3": lambda d: op3.decode(op3.encode(d)), "op5": op5_spans.drop_repeated_spans,
        "op6": lambda d: op6_licenses.scan_licenses(paths(d)), "op7": lambda d: op7_urls.judge_urls(d.withColumn("url", F.col("text"))),
        "op8": lambda d: op8.contaminated(d, bench), "op9": lambda d: op9.judged(d, labels),
        "op2": near_duplicates, "op4": op4_lm.lm_scores, "op10": op10.quality_rules}
    for name, run in runs.items():
        want, got = run(plain), run(wide)
        assert len(set(got.columns)) == len(got.columns), name
        assert {r[0] for r in got.select(F.col("`a.b`")).distinct().collect()} == {"dotted"} if "a.b" in got.columns else True
        pick = [F.col(c).cast("string") for c in want.columns]
        assert sorted(map(str, got.select(pick).collect())) == sorted(map(str, want.select(pick).collect())), name


def test_pipeline_stages_pass_clashing_columns(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    wide = raw.withColumns({c: F.lit(f"own {c}") for c in STAGE_NAMES})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns
        first = out.select(*STAGE_NAMES).distinct().collect()
        assert [tuple(r) for r in first] == [tuple(f"own {c}" for c in STAGE_NAMES)]


STAGE_NAMES = [c for c in CLASHING if "." not in c]


def test_pipeline_keeps_the_columns(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*raw.columns, "ids"] and 0 < out.count() <= raw.count()
    again = raw
    for _, stage in corpus_pipeline.STAGES[:-1]:
        again = stage(spark, again, sf)
        assert again.columns == raw.columns


def test_registered_digests_with_sql(spark):
    import duckdb

    from check_queries import TABLES, compare
    from noticeboard.llm.oracle import ORACLE
    from noticeboard.llm.queries import QUERIES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in ORACLE.items():
        assert compare(spark, con, "/root/testdata/sf0.001", name, QUERIES[name], sql).startswith("ok"), name
