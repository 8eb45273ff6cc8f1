"""Licence scans: a trained paragraph classifier in DataFrame functions.

A sparse multinomial logistic regression over word 1-grams and 2-grams is trained on the licence
notices below, short ones made of the licences' names and SPDX identifiers, shortened variants of
them, and paragraphs that only talk about licences or deny one (the unknown class).  Paragraphs of the
corpus are a line, several lines in a row, as notices are wrapped, or all lines between two blank ones.
Those with a word that every notice has one of are scored by joining their n-grams with the weight
table, whose size is fixed by the notices; a comparison with the family's notices, word pair by word
pair, confirms a prediction.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UID, Scratch, table, with_uid

# Notices of common licence families.
_WRITTEN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under Apache-2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    ("MIT", "MIT License"),
    ("MIT", "Licensed under MIT."),
    ("MIT", "Dual licensed under MIT or another license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "GNU General Public License"),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("LGPL", "GNU Lesser General Public License"),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("AGPL", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL", "GNU Affero General Public License"),
    ("AGPL", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "BSD 3-Clause License"),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
    ("EPL", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("CC-BY-SA", "This text is available under the Creative Commons Attribution-ShareAlike License 4.0."),
    ("CC-BY", "This text is available under the Creative Commons Attribution License 4.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    ("CC0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without prior written permission."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."),
)
# Names of licences by family, their SPDX identifiers, and phrases that put a work under one.
NAMES = (
    ("Apache-2.0", ("Apache License 2.0", "Apache License", "Apache 2.0 license")), ("MIT", ("MIT License", "MIT")),
    ("GPL", ("GPL", "GPLv2", "GPLv3", "GPL v2", "GPL v3", "GNU GPL", "GNU General Public License", "GNU General Public License v3.0")),
    ("LGPL", ("LGPL", "LGPLv2.1", "LGPLv3", "LGPL v3", "GNU LGPL", "GNU Lesser General Public License")), ("AGPL", ("AGPL", "AGPLv3", "AGPL v3", "GNU AGPL", "GNU Affero General Public License")),
    ("BSD", ("BSD license", "BSD 2-Clause License", "BSD 3-Clause License", "new BSD license")), ("MPL-2.0", ("Mozilla Public License 2.0", "MPL 2.0", "MPL")),
    ("ISC", ("ISC License",)), ("Zlib", ("zlib license",)), ("EPL", ("Eclipse Public License 2.0", "Eclipse Public License v1.0", "EPL 2.0")), ("CC0", ("CC0", "CC0 1.0")), ("Unlicense", ("Unlicense",)),
)
SPDX = (
    ("Apache-2.0", ("Apache-2.0",)), ("MIT", ("MIT",)), ("GPL", ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-3.0")),
    ("LGPL", ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-2.1", "LGPL-3.0")), ("AGPL", ("AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0")),
    ("BSD", ("BSD-2-Clause", "BSD-3-Clause")), ("MPL-2.0", ("MPL-2.0",)), ("ISC", ("ISC",)), ("Zlib", ("Zlib",)), ("EPL", ("EPL-1.0", "EPL-2.0")), ("CC-BY", ("CC-BY-3.0", "CC-BY-4.0")),
    ("CC-BY-SA", ("CC-BY-SA-3.0", "CC-BY-SA-4.0")), ("CC-BY-NC", ("CC-BY-NC-4.0",)), ("CC0", ("CC0-1.0",)), ("Unlicense", ("Unlicense",)),
)
PHRASES = ("Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "Distributed under the terms of the {}.", "It is available under the {}.")
NOTICES = tuple(dict.fromkeys((
    *_WRITTEN, *((family, phrase.format(name)) for family, names in NAMES for name in names for phrase in PHRASES),
    *((family, f"SPDX-License-Identifier: {name}") for family, names in SPDX for name in names))))
# Phrases that deny a licence or only name one, and word pairs that deny one.
DENIALS = ("This is not released under the {}.", "It is no longer licensed under the {}.", "The code was never available under the {}.", "Students compare the {} with other texts in their first year.")
DENYING = tuple(f"{a} {b}" for a in ("not", "never", "longer", "t") for b in ("released", "licensed", "distributed", "available", "covered", "governed", "published", "offered", "under"))
# Paragraphs that share words with notices without being one.
OTHERS = (
    "The driver was asked for a license and a registration.",
    "A license to fish costs ten dollars and is valid for one season.",
    "The public library is open to any person without charge.",
    "They released a new version of the program last week.",
    "The software foundation held its general meeting in spring.",
    "You may not use this road without permission of the owner.",
    "The source of the river lies in the mountains.",
    "A copy of the document was granted to the applicant.",
    "The creative team won international attribution for its work.",
    "Modern forms of government require general public consent.",
    "The following conditions were observed in the patient.",
    "The Apache helicopter landed at the base in version two of the plan.",
    "She studied at MIT before she joined the company.",
    "Distribution of the goods begins at the port.",
    "The file was found in the original box.",
    "Licensed plumbers work under the terms of the city.",
    "The author reserved a table for any later guests.",
    "All rights come with duties.",
    "Licensed under the Artistic License 2.0.",
    "Licensed under the European Union Public Licence 1.1.",
    "Released under the Open Font License.",
    "SPDX-License-Identifier: Artistic-2.0",
    "SPDX-License-Identifier: OFL-1.1",
    "SPDX-License-Identifier: Python-2.0",
    "This product is licensed under the terms of a licence agreement.",
    "The licence agreement is subject to the terms of the contract.",
    "Copyright law protects the work of an author.",
    "Permission to use the hall was granted by the owner.",
    "Rights are reserved for members.",
    "Ich fahre mit dem Zug und lese ein Buch mit vielen Seiten.",
    "Die Kinder spielen mit dem Ball.",
    "Il est parti en version originale avec la source du fichier.",
    "La obra general fue publicada en la ciudad.",
    "mit der", "la version", "in general", "the work", "by 4 0", "nc", "cc", "as is", "to use", "a copy",
    "He gave notice in writing and without fee.",
    "The domain of the function is the set of real numbers.",
)
# Words too common to be evidence by themselves.
STOP = frozenset("a an and any are as at be by can for from if in is it its no not of on or that the this to was were with you your we they he she may under all".split())
WORDS = r"[^a-z0-9]+"
# Each notice has one of these words; in lower case "mit" is a common word of German.
ANCHORS = r"\b(?:MIT|(?i:affero|apache|bsd|cc|cc0|copyright|eclipse|epl|gnu|[al]?gpl\w*|isc|mit[ -]licen[cs]e|mozilla|mpl|zlib|unlicense|warranty|licen[cs]ed?|creative|attribution|spdx|permission|redistribut\w+|unencumbered|waived|reserved|proprietary|confidential))\b"
#: (lines before the line with such a word, lines in all) of paragraphs; those between blank lines come besides.
RUNS = ((0, 1), (0, 2), (0, 3), (0, 5), (1, 2), (1, 3), (0, 8), (2, 8), (0, 16), (4, 16))
#: Characters of a paragraph of several lines: the longest notice with as much again before and after it.
#: Longer ones are told by their parts, down to single lines, which have any length.
LONGEST = 3 * max(len(text) for _, text in NOTICES)
#: The calibrated probability that a paragraph is a notice at all, that of a family, and the share of a
#: notice's word pairs that confirms it, of a notice of fewer than SHORT pairs a larger one. One of them must
#: be a pair that no other family's notices have.
MIN_KNOWN, MIN_PROBABILITY, MIN_COVER, SHORT, SHORT_COVER = 0.5, 0.05, 0.6, 6, 0.75


def words_of(paragraph: str) -> list[str]:
    return [w for w in re.split(WORDS, paragraph.lower()) if w]


def features_of(words: list[str]) -> set[str]:
    single = {w for w in words if w not in STOP}
    return single | {f"{a} {b}" for a, b in zip(words, words[1:]) if a in single or b in single}


def pairs_of(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def templates() -> list[tuple[str, list[str], list[str]]]:
    """(family, pairs, own pairs) of each notice: own ones are in no other family's notices."""
    of = [(family, pairs_of(words_of(text))) for family, text in NOTICES]
    return [(family, sorted(pairs), sorted(pairs.difference(*(p for f, p in of if f != family)))) for family, pairs in of]


def _variants(words: list[str]) -> list[list[str]]:
    """The notice, it without each fifth of its words, and its halves if long."""
    n = len(words)
    out = [words, ["copyright", "2019", "jane", "doe", *words]]
    if n >= 8:
        out += [[w for i, w in enumerate(words) if i * 5 // n != k] for k in range(5)]
    if n >= 16:
        out += [words[: n // 2], words[n // 4 : 3 * n // 4]]
    return out


def _fit(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, decay: float) -> np.ndarray:
    """Weights by gradient descent, kept as coefficients of the samples, of which there are fewer than features.
    The last column of x is constant: its weights are the biases. Each class weighs the same."""
    share = (y / y.sum(axis=0).clip(1)).sum(axis=1, keepdims=True) * len(y) / y.shape[1]
    alike, a = x @ x.T, np.zeros_like(y)
    for _ in range(rounds):
        a += rate * (share * (y - _soft(alike @ a)) - decay * len(x) * a) / max(1.0, len(x) / 100)
    return x.T @ a


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@functools.cache
def train(rounds: int = 250, rate: float = 1.0, decay: float = 1e-4, folds: int = 4):
    """(families, bias, weights): the last family is the unknown class; weights by feature.

    The temperature that calibrates the probabilities is the one with the least loss on texts that were
    held out whole, with all their variants, fold by fold; a family's only notice is never held out.  All
    inputs are the fixed texts above.
    """
    families = [*dict.fromkeys(k for k, _ in NOTICES), "unknown"]
    denied = [denial.format(names[0]) for _, names in NAMES for denial in DENIALS]
    texts = [(name, text) for name, text in NOTICES] + [("unknown", text) for text in (*OTHERS, *denied)]
    seen, samples = [0] * len(families), []
    for name, text in texts:
        k = families.index(name)
        samples += [(fs, k, seen[k]) for v in _variants(words_of(text)) if (fs := features_of(v))]
        seen[k] += 1
    columns = {f: i for i, f in enumerate(sorted({f for fs, *_ in samples for f in fs}))}
    x, y = np.zeros((len(samples), len(columns) + 1)), np.zeros((len(samples), len(families)))
    for i, (fs, k, _) in enumerate(samples):
        x[i, [columns[f] for f in sorted(fs)]] = 1 / math.sqrt(len(fs))
        x[i, -1] = y[i, k] = 1
    fold = np.array([n % folds if seen[k] > 1 else -1 for _, k, n in samples])
    z = np.zeros_like(y)
    for n in range(folds):
        z[fold == n] = x[fold == n] @ _fit(x[fold != n], y[fold != n], rounds, rate, decay)
    held = fold >= 0
    loss = lambda t: -np.log(np.clip((_soft(z[held] / t) * y[held]).sum(axis=1), 1e-12, 1)).sum()
    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss)
    w = _fit(x, y, rounds, rate, decay) / heat
    return families, w[-1].tolist(), {f: w[i].tolist() for f, i in columns.items()}


def _literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _pairs(words) -> F.Column:
    """Neighbouring words."""
    shift = lambda at: F.slice(words, F.lit(at), F.greatest(F.lit(0), F.size(words) - 1))
    return F.zip_with(shift(1), shift(2), lambda a, b: F.concat_ws(" ", a, b))


def scan_licenses(docs: DataFrame, text_col: str = "text", min_known: float = MIN_KNOWN, min_probability: float = MIN_PROBABILITY, min_cover: float = MIN_COVER) -> DataFrame:
    """One row per input row: ``__row_uid, doc_id, n_paragraphs, n_predicted, n_notices, family,
    probability, families``.

    n_paragraphs counts the blocks between blank lines.  n_predicted counts the lines at which the model sees
    a notice begin, n_notices those at which the comparison confirms a family.  family is the most probable
    confirmed one, else null; probability belongs to it, or to the best unconfirmed one; families lists
    the confirmed ones, several for one line too (dual licences).  A paragraph that denies a licence
    ("not released under") confirms none.  Null counts as empty: no paragraphs.
    Lines of any length are paragraphs whole.  Rows that repeat a text are judged alike; of equally probable
    families the last by name is given; an empty table gives an empty result.  Only doc_id and the text
    are read, so other columns can't clash.
    """
    spark = docs.sparkSession
    families, bias, weights = train()
    known = len(families) - 1
    scratch = Scratch(spark, "licenses")
    columns = [f"w{k}" for k in range(len(families))]
    table_of_weights = _literal_table(spark, [(f, *w) for f, w in weights.items()], "feature string, " + ", ".join(f"{c} double" for c in columns))
    notices = _literal_table(spark, templates(), "family string, notice array<string>, own array<string>")
    rows = with_uid(docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    blocks = F.size(F.filter(F.split("text", r"\n[ \t\r\x0B\f]*\n"), lambda x: F.trim(F.translate(x, "\t\r\n\x0b\x0c", "     ")) != "")).cast("long")
    lines = F.when(F.col("text").rlike(ANCHORS), F.split("text", "\n"))
    lined = rows.select(UID, "doc_id", blocks.alias("n_paragraphs"), lines.alias("lines"))
    # Runs of lines from or around each line with an anchor; no blank line in a run of several.
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0))), lambda i: F.get("lines", i).rlike(ANCHORS))

    def run(start, n):
        part = F.slice("lines", start + 1, n)
        length = F.aggregate(part, n.cast("long") - 1, lambda a, x: a + F.length(x))
        fits = (length <= LONGEST) & F.forall(part, lambda x: F.trim(x) != "")
        return F.when((start >= 0) & (start + n <= F.size("lines")) & ((n == 1) | fits), F.struct(start.alias("line"), n.alias("n_lines"), F.array_join(part, " ").alias("text")))

    # The block of a line: from the blank line before it to the one after it.
    blank = F.filter(F.transform("lines", lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    lined = lined.withColumn("ends", F.when(F.col("lines").isNotNull(), F.concat(F.array(F.lit(-1)), blank, F.array(F.size("lines")))))
    blocks_of = F.filter(F.zip_with("ends", F.slice("ends", F.lit(2), F.size("ends")), lambda a, b: F.when(b - a > 1, F.struct((a + 1).alias("a"), (b - a - 1).alias("n")))), lambda x: x.isNotNull())
    long_ones = F.filter(F.transform(blocks_of, lambda x: F.when(F.exists(F.slice("lines", x["a"] + 1, x["n"]), lambda y: y.rlike(ANCHORS)), run(x["a"], x["n"]))), lambda x: x.isNotNull())
    runs = F.concat(F.flatten(F.transform(at, lambda i: F.filter(F.array(*[run(i - b, F.lit(n)) for b, n in RUNS]), lambda x: x.isNotNull()))), long_ones)
    found = scratch.keep(lined.select(UID, "doc_id", "n_paragraphs", F.when(F.col("lines").isNotNull(), F.array_distinct(runs)).alias("runs")), "found")
    words = F.filter(F.split(F.lower("text"), WORDS), lambda w: w != "")
    paragraphs = found.where("size(runs) > 0").select(UID, F.inline("runs")).select(UID, "line", "n_lines", words.alias("words"))
    stop = F.array(*map(F.lit, sorted(STOP)))
    content = lambda w: ~F.array_contains(stop, w)
    pairs = F.filter(_pairs("words"), lambda p: content(F.substring_index(p, " ", 1)) | content(F.substring_index(p, " ", -1)))
    features = F.array_distinct(F.concat(F.filter("words", content), pairs))
    key = [UID, "line", "n_lines"]
    each = paragraphs.select(*key, features.alias("features")).select(*key, F.size("features").alias("n"), F.explode("features").alias("feature"))
    scored = each.join(F.broadcast(table_of_weights), "feature").groupBy(*key).agg(F.any_value("n").alias("n"), *[F.sum(c).alias(c) for c in columns])
    # Few rows are left: arrays of the families' logits, the unknown class last.
    logits = F.array(*[F.lit(float(b)) + F.col(c) / F.sqrt("n") for b, c in zip(bias, columns)])
    scored = scored.select(*key, logits.alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("e", F.transform("z", lambda z: F.exp(z - F.col("top"))))
    scored = scored.withColumn("p", F.transform("e", lambda e: e / F.aggregate("e", F.lit(0.0), lambda a, x: a + x)))
    names = F.array(*map(F.lit, families[:known]))
    likely = F.filter(F.arrays_zip(names.alias("family"), F.slice("p", 1, known).alias("probability")), lambda x: x["probability"] >= min_probability)
    named = scored.where(1 - F.element_at("p", -1) >= min_known).select(*key, F.inline(likely))
    least = F.when(F.size("notice") < SHORT, F.lit(max(min_cover, SHORT_COVER))).otherwise(F.lit(min_cover))
    covered = (F.size(F.array_intersect("pairs", "notice")) >= least * F.size("notice")) & F.arrays_overlap("pairs", "own") & ~F.arrays_overlap("pairs", F.array(*map(F.lit, DENYING)))
    named = named.join(paragraphs.select(*key, _pairs("words").alias("pairs")), key).join(F.broadcast(notices), "family").groupBy(*key, "family").agg(
        F.any_value("probability").alias("probability"), F.bool_or(covered).alias("confirmed"))
    top = F.max(F.struct("confirmed", "probability", "family"))
    by_doc = named.groupBy(UID).agg(
        F.count_distinct("line").alias("n_predicted"), F.count_distinct(F.when(F.col("confirmed"), F.col("line"))).alias("n_notices"), top.alias("top"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"))
    return found.select(UID, "doc_id", "n_paragraphs").join(by_doc, UID, "left").select(
        UID, "doc_id", "n_paragraphs", F.coalesce("n_predicted", F.lit(0)).cast("long").alias("n_predicted"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.when(F.col("top.confirmed"), F.col("top.family")).alias("family"), F.col("top.probability").alias("probability"), F.coalesce("families", F.lit("")).alias("families"))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop(UID)
