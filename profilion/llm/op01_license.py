"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every file is read whole. Each of its lines is a bag of lower-case words, held against short notices; words are weighted
by count times inverse document frequency over these (words that no notice has weigh most, so foreign
text lowers a score). Each run of neighbouring comment or notice lines, each paragraph and the whole text are held
against headers, titles and whole licence texts (``licences/``); there, words are weighted by their
document frequency over all files, counted in Spark. An SPDX identifier names its licence and scores 1.
A file's own licence is that of the highest score, if that reaches the threshold.

By the Cauchy-Schwarz inequality a bag reaches the threshold only if a template's words that it has carry that share of the
template's norm, and words of templates that share of its own (other words weigh their count at least). A file, line or
unit for which this fails cannot score, and goes no further; no key words are asked for. What is left is a sparse product:
a join on words with the templates' weights, a fixed table.

A file without a licence of its own inherits: every directory that holds files with one declares it (that
of the first such path), every other file looks up all its ancestor directories by an equi-join on path,
and takes the deepest that declares one.

Cases: null or empty texts and texts without notices have no licence of their own; ties go to the first
template name, then the first path; a null path belongs to no directory; rows are files each on their own, whatever their
ids, which may be null or repeated; very long texts are split into lines, never cut; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from profilion.llm import textkit as tk
from profilion.llm.cluster import settle

THRESHOLD = 0.6
#: Lines that belong to a run as comment lines do.
NOTICE = re.compile("(?i)licen[cs]e|copyright|spdx-|permission is")
WORD = r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]"
#: Common notices of public licences.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License)."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense license."),
)
#: Words that tell licences of one family apart. A line has a template's licence only if it has the same ones of these, and
#: the template's version.
MARKS = ("affero", "lesser", "by-nc", "by-nd", "by-sa", "by-nc-nd", "by-nc-sa", "attribution-sharealike", "attribution-noncommercial", "noncommercial", "sharealike", "noderivatives")
VERSION = r"[0-9]+(?:\.[0-9]+)*"

GNU = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
GNU_REST = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have received a copy of the GNU {1}General Public License along with this {0}. If not, see <https://www.gnu.org/licenses/>."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
#: The headers and titles of public licences, by paragraph and as a whole.
HEADERS = (
    *((name, text.format(*how)) for name, *how in (("AGPL-3.0", "program", "Affero ", "3"), ("GPL-2.0", "program", "", "2"), ("GPL-3.0", "program", "", "3"), ("LGPL-2.1", "library", "Lesser ", "2.1"), ("LGPL-3.0", "library", "Lesser ", "3")) for text in (GNU, GNU + GNU_REST)),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", APACHE + ' http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
#: How a comment line begins, and pairs that enclose comment lines.
COMMENT = ("#", "//", "*", "--", ";", "%", "..", "!", "'")
ENCLOSED = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"), ("(*", "*)"), ("{-", "-}"))
SPDX_ID = r"[A-Za-z0-9.]+(?:-[A-Za-z0-9.]+)*\+?"
SPDX = rf"(?i)spdx-license-identifier:\s*(\(?{SPDX_ID}\)?(?:\s+(?:AND|OR|WITH)\s+\(?{SPDX_ID}\)?)*)"


def full_templates() -> list[tuple[str, str]]:
    """Headers, titles and whole licence texts."""
    return [*HEADERS, *((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licences").glob("*.txt")))]


def units(lines: list[str], words: list[list[str]]) -> Iterator[list[int]]:
    """Lines of each run of neighbouring comment or notice lines, of each paragraph (between lines without words), and all."""
    run, paragraph, until = [], [], None
    for at, line in enumerate(lines):
        bare, comment = line.strip(), until is not None
        if until is None:
            opened = next((x for x in ENCLOSED if bare.startswith(x[0])), None)
            comment = opened is not None or bare.startswith(COMMENT)
            if opened and opened[1] not in bare[len(opened[0]) :]:
                until = opened[1]
        elif until in bare:
            until = None
        if comment or NOTICE.search(line):
            run.append(at)
        elif run:
            yield run
            run = []
        if words[at]:
            paragraph.append(at)
        elif paragraph:
            yield paragraph
            paragraph = []
    yield from (x for x in (run, paragraph) if x)
    yield list(range(len(lines)))


def template_weights(templates=TEMPLATES) -> tuple[list[tuple[int, str, str, float, float]], float]:
    """Rows (template, name, word, idf, weight over norm), and the idf of words that no template has."""
    bags = [Counter(re.findall(WORD, text.lower())) for _, text in templates]
    spread = Counter(w for bag in bags for w in bag)
    idf = lambda w: math.log((1 + len(bags)) / (1 + spread[w])) + 1
    rows = []
    for k, ((name, _), bag) in enumerate(zip(templates, bags, strict=True)):
        norm = math.sqrt(sum((n * idf(w)) ** 2 for w, n in bag.items()))
        rows += [(k, name, w, idf(w), n * idf(w) / norm) for w, n in sorted(bag.items())]
    return rows, math.log(1 + len(bags)) + 1


class Bound:
    """Which bags of words may reach a threshold: templates' weights by word, each template's of norm 1."""

    def __init__(self, rows: list[tuple[int, str, float, float]], rare: float, threshold: float) -> None:
        self.rare, self.least = rare, threshold * threshold * (1 - 1e-9)
        self.idf, self.shares, self.place = {w: idf for _, w, idf, _ in rows}, np.zeros((1 + max(t for t, *_ in rows), len({r[1] for r in rows}))), {}
        for t, w, _, share in rows:
            self.shares[t, self.place.setdefault(w, len(self.place))] = share * share

    def template(self, words: set[str]) -> bool:
        """Whether some template may be reached by bags of these words."""
        known = [self.place[w] for w in words if w in self.place]
        return bool(known) and bool(self.shares[:, known].sum(axis=1).max() >= self.least)

    def bag(self, bag: Counter) -> bool:
        known = other = 0.0
        for w, n in bag.items():
            idf = self.idf.get(w)
            if idf is None:
                other += (n * self.rare) ** 2
            else:
                known += (n * idf) ** 2
        return known >= self.least * (known + other) and self.template(set(bag))


FILE, LINE, UNIT, NAMED = range(4)
SCANNED = "kind int, key long, path string, unit int, word string, n long"


def scanned(files: DataFrame, lines: Bound, larger: Bound) -> DataFrame:
    """Written rows of four kinds: every file and its key; bags of lines, and of larger units, that may reach the threshold; and
    SPDX identifiers (in word)."""
    sent = files.sparkSession.sparkContext.broadcast((lines, larger))  # the words of fixed templates
    schema = StructType([*_parse_datatype_string(SCANNED).fields, files.schema["file_id"]])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, larger = sent.value
        word, spdx = re.compile(WORD), re.compile(SPDX)
        for b in batches:
            n = b.num_rows
            ids = b.column("file_id")
            yield pa.RecordBatch.from_arrays([pa.array([FILE] * n, pa.int32()), b.column("key"), b.column("path"), *(pa.nulls(n, t) for t in (pa.int32(), pa.string(), pa.int64())), ids], names)
            held = []

            def batch(held=held, ids=ids) -> pa.RecordBatch:
                kind, key, unit, said, many = zip(*held, strict=True) if held else ((),) * 5
                m = len(held)
                return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.nulls(m, pa.string()), pa.array(unit, pa.int32()), pa.array(said, pa.string()), pa.array(many, pa.int64()), pa.nulls(m, ids.type)], names)

            for key, text in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
                text = text.as_py() or ""
                lowered = text.lower()
                seen = set(word.findall(lowered))
                short, long = lines.template(seen), larger.template(seen)
                if short or long:  # no word goes over a line feed
                    each = [word.findall(x) for x in lowered.split("\n")]
                if short:
                    for at, said in enumerate(each):
                        bag = Counter(said)
                        if bag and lines.bag(bag):
                            held += [(LINE, key, at, w, n) for w, n in bag.items()]
                if long:
                    known = set()
                    for at, of in enumerate(units(text.split("\n"), each)):
                        if (of[0], of[-1], len(of)) in known:  # a paragraph may be the run, or all there is
                            continue
                        known.add((of[0], of[-1], len(of)))
                        bag = Counter(chain.from_iterable(each[k] for k in of))
                        if bag and larger.bag(bag):
                            held += [(UNIT, key, at, w, n) for w, n in bag.items()]
                if "spdx-license-identifier" in lowered:
                    held += [(NAMED, key, 0, m[1], 1) for m in spdx.finditer(text)]
                if len(held) > 50_000:
                    yield batch()
                    held.clear()
            yield batch()

    keyed = files.select("file_id", F.col("path").cast("string").alias("path"), "text", F.monotonically_increasing_id().alias("key"))
    return settle(keyed.mapInArrow(tk.tidy(run), schema))


def products(counts: DataFrame, templates: DataFrame, threshold: float, told_apart: bool = False) -> DataFrame:
    """(key, name, score) of bags (key, unit, word, w) and templates (template, name, word, share) that reach the threshold. told_apart:
    only where a bag has the template's versions, and the same marks of its family as the template."""
    mark = F.col("word").isin(*MARKS).cast("int")
    version = F.col("word").rlike(f"^{VERSION}$").cast("int")
    wants = templates.groupBy("template").agg(F.sum(version).alias("versions"), F.sum(mark).alias("wanted"))
    norms = counts.groupBy("key", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(mark).alias("marks"))
    dots = counts.join(F.broadcast(templates), "word").groupBy("key", "unit", "template", "name").agg(F.sum(F.col("w") * F.col("share")).alias("dot"), F.sum(version).alias("has"), F.sum(mark).alias("common"))  # the words of fixed templates
    found = dots.join(norms, ["key", "unit"])
    if told_apart:
        found = found.join(F.broadcast(wants), "template").where((F.col("has") == F.col("versions")) & (F.col("common") == F.col("wanted")) & (F.col("common") == F.col("marks")))  # a row for each template
    return found.select("key", "name", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)


def spdx_scores(found: DataFrame) -> DataFrame:
    """(key, name, score) of SPDX identifiers; -only and -or-later name the same licence."""
    names = sorted({name for name, _ in (*TEMPLATES, *full_templates())})
    known = F.create_map(*(F.lit(x) for name in names for x in (name.lower(), name)))
    said = F.regexp_replace(F.regexp_replace("word", r"^\(([^()]*)\)$", "$1"), r"(?i)(?:-only|-or-later|\+)(?=[\s)]|$)", "")
    return found.select("key", F.coalesce(known[F.lower(said)], said).alias("name"), F.lit(1.0).alias("score"))


def spread_of(files: DataFrame) -> DataFrame:
    """(word, spread): in how many files each word occurs. Tasks add up their files first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, spread = re.compile(WORD), Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(spread), pa.string()), pa.array(list(spread.values()), pa.int64())], ["word", "spread"])

        for b in batches:
            for text in b.column("text"):
                spread.update(set(word.findall((text.as_py() or "").lower())))
                if len(spread) > 200_000:
                    yield told()
                    spread.clear()
        yield told()

    return files.select("text").mapInArrow(tk.tidy(run), "word string, spread long").groupBy("word").agg(F.sum("spread").alias("spread"))


def own_licences(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All files (key, file_id, path), and (key, licence, score) of those that carry a licence of their own."""
    spark, total = files.sparkSession, files.count()
    rows, rare = template_weights(templates)
    short = spark.createDataFrame(rows, "template int, name string, word string, idf double, share double")
    spread = settle(spread_of(files))
    idf = F.log((1.0 + total) / (1.0 + F.coalesce("spread", F.lit(0)))) + 1.0
    bags = [(k, name, w, n) for k, (name, text) in enumerate(full_templates()) for w, n in sorted(Counter(re.findall(WORD, text.lower())).items())]
    fixed = spark.createDataFrame(bags, "template int, name string, word string, n long").join(spread, "word", "left").withColumn("idf", idf).withColumn("w", F.col("n") * F.col("idf"))
    sizes = fixed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    fixed = settle(fixed.join(sizes, "template").select("template", "name", "word", "idf", (F.col("w") / F.col("size")).alias("share")))
    larger = [(r["template"], r["word"], r["idf"], r["share"]) for r in fixed.collect()]  # the words of fixed templates
    found = scanned(files, Bound([(t, w, i, x) for t, _, w, i, x in rows], rare, threshold), Bound(larger, 1.0, threshold))

    lines = found.where(F.col("kind") == LINE).join(F.broadcast(short.select("word", "idf").distinct()), "word", "left")  # the same
    lines = lines.select("key", "unit", "word", (F.col("n") * F.coalesce("idf", F.lit(rare))).alias("w"))
    units_ = found.where(F.col("kind") == UNIT).join(spread, "word", "left").select("key", "unit", "word", (F.col("n") * idf).alias("w"))
    scores = products(lines, short.select("template", "name", "word", "share"), threshold, True).unionByName(products(units_, fixed.drop("idf"), threshold)).unionByName(spdx_scores(found.where(F.col("kind") == NAMED)))
    best = scores.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("low"), "name")).alias("b"))
    return found.where(F.col("kind") == FILE).select("key", "file_id", "path"), best.select("key", F.col("b.name").alias("licence"), (-F.col("b.low")).alias("score"))


def ancestors(path: str = "path"):
    """Directories above a path, the nearest first; the root is the empty path."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.size(steps) - 1, F.lit(0), F.lit(-1)), lambda k: F.concat_ws("/", F.slice(steps, F.lit(1), k)))


def scan(files: DataFrame, **how) -> DataFrame:
    """(file_id, path, licence, score, inherited_from) for every row of files (file_id, path, text)."""
    rows, found = own_licences(files, **how)
    rows = settle(rows.join(found, "key", "left").drop("key"))
    declared = rows.where("licence IS NOT NULL AND path IS NOT NULL").withColumn("directory", F.element_at(ancestors(), 1)).groupBy("directory").agg(F.min(F.struct("path", "licence")).alias("first"))
    declared = declared.select("directory", F.col("first.licence").alias("given"))
    # paths are looked up once for each directory that holds files, however many those are
    homes = rows.where("path IS NOT NULL").select(F.element_at(ancestors(), 1).alias("home")).distinct()
    above = homes.select("home", F.explode(F.array_union(F.array("home"), F.when(F.col("home") == "", F.array().cast("array<string>")).otherwise(ancestors("home")))).alias("directory"))
    nearest = above.join(declared, "directory").groupBy("home").agg(F.max(F.struct(F.length("directory").alias("depth"), "directory", "given")).alias("near"))
    nearest = nearest.select("home", F.col("near.directory").alias("inherited_from"), F.col("near.given").alias("given"))
    rows = rows.withColumn("home", F.element_at(ancestors(), 1)).join(nearest, "home", "left")
    own = F.col("licence").isNotNull()
    return rows.select("file_id", "path", F.coalesce("licence", "given").alias("licence"), "score", F.when(~own, F.col("inherited_from")).alias("inherited_from"))


def op1_license(spark, sf_dir: str) -> DataFrame:
    """All documents as files: source/lang/block/doc_id, some directly under their source or language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = F.when(F.col("doc_id") % 97 == 0, F.col("source")).when(F.col("doc_id") % 13 == 0, F.concat_ws("/", "source", "lang")).otherwise(F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 640).cast("string")))
    files = docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", folder, F.col("doc_id").cast("string")).alias("path"), "text")
    return scan(files).withColumnRenamed("file_id", "doc_id")


def _oracle() -> str:
    rows, rare = template_weights()
    values = ", ".join(f"({k}, '{name}', '{word}', {idf!r}::DOUBLE, {share!r}::DOUBLE)" for k, name, word, idf, share in rows)
    mark, version = f"word IN {MARKS}", f"regexp_full_match(word, '{VERSION}')"
    return rf"""
WITH weights(template, name, word, idf, share) AS (VALUES {values}),
files AS (SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN source WHEN doc_id % 13 = 0 THEN source || '/' || lang
  ELSE source || '/' || lang || '/' || CAST(doc_id // 640 AS VARCHAR) END AS home, text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS notice FROM files),
numbered AS (SELECT doc_id, row_number() OVER () AS line, notice FROM lines),
terms AS (SELECT doc_id, line, unnest(regexp_extract_all(lower(notice), '{WORD}')) AS word FROM numbered),
counts AS (SELECT doc_id, line, word, count(*) AS n FROM terms GROUP BY ALL),
weighed AS (SELECT c.*, n * coalesce(idf, {rare!r}::DOUBLE) AS w FROM counts c LEFT JOIN (SELECT DISTINCT word, idf FROM weights) USING (word)),
wants AS (SELECT template, count(*) FILTER ({version}) AS versions, count(*) FILTER ({mark}) AS wanted FROM weights GROUP BY ALL),
norms AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm, count(*) FILTER ({mark}) AS marks FROM weighed GROUP BY ALL),
dots AS (SELECT doc_id, line, template, name, sum(w * share) AS dot, count(*) FILTER ({version}) AS has, count(*) FILTER ({mark}) AS common FROM weighed JOIN weights USING (word) GROUP BY ALL),
scores AS (SELECT doc_id, name, round(dot / norm, 6) AS score FROM dots JOIN norms USING (doc_id, line) JOIN wants USING (template) WHERE has = versions AND common = wanted AND common = marks),
own AS (SELECT doc_id, arg_min(name, (-score, name)) AS own, max(score) AS score FROM scores WHERE score >= {THRESHOLD} GROUP BY doc_id),
all_files AS (SELECT f.doc_id, f.home, f.home || '/' || CAST(f.doc_id AS VARCHAR) AS path, own, score FROM files f LEFT JOIN own USING (doc_id)),
declared AS (SELECT home AS directory, arg_min(own, path) AS given FROM all_files WHERE own IS NOT NULL GROUP BY home),
near AS (SELECT h.home, arg_max(directory, length(directory)) AS directory, arg_max(given, length(directory)) AS given
  FROM (SELECT DISTINCT home FROM all_files) h JOIN declared d ON h.home = d.directory OR starts_with(h.home, d.directory || '/') GROUP BY h.home)
SELECT doc_id, path, coalesce(own, given) AS licence, score, CASE WHEN own IS NULL THEN directory END AS inherited_from
FROM all_files LEFT JOIN near USING (home)
"""


ORACLE = _oracle()
