"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

Pieces of a file are compared: every line that holds a licensing cue and its sentences; runs of 3 to 32 lines from
each place where cues begin (a header block, however it is commented); and, of a licence file (LICENSE, COPYING,
NOTICE), the whole text. Each is a sparse vector of words, weighted by the inverse frequency of the word among the
templates: one-line notices, standard headers, and full licence texts (licenses/*.txt). Beside headers and full texts
only words of the templates count, so that names and other foreign words do not dilute; beside one-line notices the
foreign words weigh as the rarest, so that a stray name is no licence. The best cosine names the licence; a whole
licence file that reaches WHOLE_COSINE comes before its parts, and 'All rights reserved' after any licence.
A licence file stands for its directory; files without a notice of their own take the licence of the nearest
directory above them that has one, by joins of directory paths. Only column expressions and joins; templates are a
fixed table, directories are resolved once each.

Nulls and ties: null text has no notices, null path no directory; ties go to the first licence by name, then to
the first path; repeated rows are judged alike; extra columns pass through.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from noticeboard.llm.tables import small_side, spared, stored

CUE = (r"(?i)licen[cs]e|copyright|rights reserved|public domain|spdx-|permission is hereby granted|"
       r"permission to use, copy|redistribution and use|free software")
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"
LEAST_COSINE = 0.55
WHOLE_COSINE = 0.8
RUNS = [3, 6, 10, 16, 24, 32]  # lines
RESTART = 8                    # lines after which a run begins anew inside a stretch of cues
GENERIC = "Proprietary"
# Notices as projects write them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "Released under the ISC License"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    (GENERIC, "All rights reserved"),
]
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General
Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for
more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""
# Standard headers of source files.
HEADERS = [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License."""),
    ("Apache-2.0", """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See
the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses
this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License."""),
    ("GPL-2.0", _GNU.format("", "2")), ("GPL-3.0", _GNU.format("", "3")), ("LGPL-2.1", _GNU.format("Lesser ", "2.1")),
    ("LGPL-3.0", _GNU.format("Lesser ", "3")), ("AGPL-3.0", _GNU.format("Affero ", "3")),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]
_WORD = r"[a-z0-9]+"


def all_templates() -> list[tuple[str, str, bool]]:
    """(licence, text, whether a one-line notice)."""
    bodies = sorted(Path(__file__).with_name("licenses").glob("*.txt"))
    return ([(name, text, True) for name, text in TEMPLATES] + [(name, text, False) for name, text in HEADERS]
            + [(p.stem, p.read_text("utf-8"), False) for p in bodies])


def template_weights() -> tuple[list[tuple[str, int, bool, str, float]], dict[str, float], float]:
    """((licence, template, one-line, word, unit weight) rows, weight of a word, weight of an unknown word)."""
    templates = all_templates()
    bags = [Counter(re.findall(_WORD, text.lower())) for _, text, _ in templates]
    seen = Counter(w for bag in bags for w in bag)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in seen.items()}
    rows = []
    for k, ((name, _, short), bag) in enumerate(zip(templates, bags, strict=True)):
        weight = {w: (1 + math.log(n)) * idf[w] for w, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        rows += [(name, k, short, w, x / norm) for w, x in weight.items()]
    return rows, idf, math.log(1 + len(bags)) + 1


def pieces(texts: DataFrame) -> DataFrame:
    """(_key, piece, whole) of texts (_key, text, whole: whether a licence file) that hold a cue."""
    lines = stored(texts.select("_key", "whole", F.split("text", "\r?\n").alias("lines")), "notice-lines")
    cued = F.filter("lines", lambda x: x.rlike(CUE))
    sentences = F.filter(F.flatten(F.transform(cued, lambda x: F.split(x, r"(?<=[.;!?])\s+"))), lambda x: x.rlike(CUE))
    whole = F.when(F.col("whole"), F.array(F.concat_ws("\n", "lines"))).otherwise(F.array().cast("array<string>"))
    begins = F.filter(F.transform("lines", lambda x, i: F.when(
        x.rlike(CUE) & ((i % RESTART == 0) | ~F.coalesce(F.get("lines", i - 1).rlike(CUE), F.lit(False))), i)),
        lambda i: i.isNotNull())
    # The line before a cue often begins the header's sentence.
    spans = F.array_distinct(F.flatten(F.transform(begins, lambda i: F.flatten(F.array(*(
        F.array(*(F.struct(at.alias("at"), F.least(F.size("lines") - at, F.lit(n)).alias("n")) for n in RUNS))
        for at in (i, F.greatest(i - 1, F.lit(0)))))))))
    runs = lines.select("_key", "lines", F.explode(spans).alias("s")).select(
        "_key", F.concat_ws("\n", F.slice("lines", F.col("s.at") + 1, F.col("s.n"))).alias("piece"), F.lit(False).alias("whole"))
    single = lines.select("_key", F.explode(F.array_distinct(F.concat(cued, sentences))).alias("piece"), F.lit(False).alias("whole"))
    return runs.union(single).union(lines.select("_key", F.explode(whole).alias("piece"), F.lit(True).alias("whole")))


def named_lines(lines: DataFrame) -> DataFrame:
    """(line, license, cosine) of distinct pieces, the best template of each that reaches LEAST_COSINE."""
    spark = lines.sparkSession
    rows, idf, unknown = template_weights()
    templates = F.broadcast(spark.createDataFrame(rows, "license string, template int, short boolean, word string, unit double"))
    scale = F.broadcast(spark.createDataFrame(list(idf.items()), "word string, idf double"))
    found = lines.select(F.xxhash64("line").alias("line"), F.explode(
        F.regexp_extract_all(F.lower("line"), F.lit(f"({_WORD})"))).alias("word"))
    words = (found.groupBy("line", "word").agg(F.count("*").alias("n")).join(scale, "word", "left")
             .withColumn("weight", (1 + F.log("n")) * F.coalesce("idf", F.lit(unknown))))
    words = stored(words.select("line", "word", "weight", F.col("idf").isNotNull().alias("known")), "notice-words")
    square = F.col("weight") * F.col("weight")
    norms = words.groupBy("line").agg(F.sqrt(F.sum(square)).alias("norm"), F.sqrt(F.sum(F.when(F.col("known"), square))).alias("known_norm"))
    dots = (words.join(templates, "word").groupBy("line", "license", "template", "short")
            .agg(F.sum(F.col("weight") * F.col("unit")).alias("dot")))
    norm = F.when(F.col("short"), F.col("norm")).otherwise(F.col("known_norm"))
    best = (dots.join(norms, "line").withColumn("cosine", F.round(F.col("dot") / norm, 6))
            .filter(F.col("cosine") >= LEAST_COSINE).groupBy("line")
            .agg(F.min(F.struct((F.col("license") == GENERIC).alias("generic"), (-F.col("cosine")).alias("order"), "license")).alias("best")))
    return best.select("line", F.col("best.license").alias("license"), (-F.col("best.order")).alias("cosine"))


def scan_licenses(files: DataFrame) -> DataFrame:
    """files (path, text, any others) with _license, _cosine and _how: header, inherited or null. Columns of these
    three names are replaced."""
    plain, restored = spared(files, {"path", "text"})
    path = F.col("path").cast("string")
    text = F.col("text").cast("string")
    name = F.element_at(F.split(path, "/"), -1)
    whole = F.coalesce(name.rlike(LICENCE_FILE), F.lit(False))
    keyed = plain.withColumns({"_dir": F.regexp_replace(path, r"/?[^/]*$", ""), "_key": F.xxhash64(text, whole)})
    # A text that a third of all files bear is cut once, and of distinct pieces each is scored once.
    cut = stored(pieces(keyed.filter(text.rlike(CUE)).select("_key", text.alias("text"), whole.alias("whole")).distinct()), "notices")
    known = small_side(stored(named_lines(cut.select(F.col("piece").alias("line")).distinct()), "notice-names"))
    order = F.struct((F.col("license") == GENERIC).alias("generic"), (~(F.col("whole") & (F.col("cosine") >= WHOLE_COSINE))).alias("part"),
                     (-F.col("cosine")).alias("order"), "license")
    found = (cut.select("_key", "whole", F.xxhash64("piece").alias("line")).distinct().join(known, "line")
             .groupBy("_key").agg(F.min(order).alias("_best")))
    found = stored(found.select("_key", F.col("_best.license").alias("_own"), (-F.col("_best.order")).alias("_cos")), "headers")
    scanned = keyed.join(small_side(found), "_key", "left")

    home = (keyed.filter(name.rlike(LICENCE_FILE)).select("_key", "_dir", path.alias("file"))
            .join(small_side(found), "_key").groupBy(F.col("_dir").alias("dir"))
            .agg(F.min_by("_own", F.struct("file", "_own")).alias("license"), F.min_by("_cos", F.struct("file", "_own")).alias("cosine")))
    home = stored(home, "licence-dirs")
    steps = F.split(F.col("_dir"), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(
        n.alias("depth"), F.concat_ws("/", F.slice(steps, F.lit(1), n)).alias("dir")))
    nearest = (keyed.select("_dir").filter("_dir is not null").distinct().select("_dir", F.explode(above).alias("a"))
               .select("_dir", "a.depth", "a.dir").distinct().join(small_side(home), "dir").groupBy("_dir")
               .agg(F.max_by("license", "depth").alias("_up"), F.max_by("cosine", "depth").alias("_up_cos")))
    out = scanned.join(small_side(stored(nearest, "nearest")), "_dir", "left")
    how = F.when(F.col("_own").isNotNull(), "header").when(F.col("_up").isNotNull(), "inherited")
    return restored(out.withColumns({"_license": F.coalesce("_own", "_up"), "_cosine": F.coalesce("_cos", "_up_cos"),
                                     "_how": how}), "_license", "_cosine", "_how")
