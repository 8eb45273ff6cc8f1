"""Licence notices: wrapped, dual, near misses; the model against a plain version of it."""

import math
import re

from logweave.llm import licenses as L

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction."
GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
LGPL = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation."
ZLIB = "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely."
NARROW = "\n".join(" ".join(w) for w in (lambda all: [all[i : i + 4] for i in range(0, len(all), 4)])(GPL.split()))
LONG_LINES = "Copyright 2021 Jane Doe, John Roe, and all of the others who are named in the file of authors at the top of the tree. Licensed under the Apache License, Version 2.0 (the License);\nyou may not use this file except in compliance with the License, of which a copy is kept beside this file and at the address that is given at the end of this text, so that all find it."
CASES = [
    (MIT, "MIT"), (GPL, "GPL"), (BSD, "BSD"), (LGPL, "LGPL"), ("".join(f"# {x}\n" for x in GPL.split("\n")), "GPL"), ("/*\n * " + MIT.replace("\n", "\n * ") + "\n */\nint main;", "MIT"),
    ("Prose before it\nin short lines, as mails have them.\n" + BSD + "\nand more prose.", "BSD"), ("All rights reserved.", "Proprietary"), ("Copyright (c) 2019 Jane Doe. All rights reserved.", "Proprietary"),
    ("MIT License\n\nCopyright (c) 2020 Jane Doe", "MIT"), ("Dual licensed under MIT and Apache-2.0.", "Apache-2.0,MIT"), ("Licensed under the Eclipse Public License 2.0.", "EPL"), ("Er kam mit der License.", ""),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA"), ("A license to drive is issued by the state.", ""), ("Apache landed; all rights were read to them.", ""),
    ("SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL"), ("SPDX-License-Identifier: GPL-2.0-only", "GPL"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD"), ("SPDX-License-Identifier: CC-BY-4.0", "CC-BY"),
    ("SPDX-License-Identifier: EPL-2.0", "EPL"), ("// SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"), ("Released under the GPL v3.", "GPL"), ("Licensed under the GPLv2.", "GPL"), ("Released under the BSD license.", "BSD"),
    (ZLIB, "Zlib"), (NARROW, "GPL"), ("The text is available under the Creative Commons Attribution-ShareAlike License 4.0", "CC-BY-SA"), ("This is not released under the MIT License.", ""), ("It isn't licensed under the GPL.", ""),
    ("Licensed under the European Union Public Licence 1.2.", ""), ("SPDX-License-Identifier: Ruby", ""), (LONG_LINES, "Apache-2.0"),
    ("SPDX-License-Identifier: AGPL-3.0-only", "AGPL"), ("Copyright law and the rights of an author.", ""), ("", ""), (None, ""), ("x\n" * 5_000 + "Released under the MIT License.\n" + "y " * 50_000, "MIT"),
]


def test_notices(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, 1.0) for i, (t, _) in enumerate(CASES)], "doc_id long, text string, probability double").repartition(3).write.parquet(path)
    got = {r.doc_id: r for r in L.scan_licenses(spark.read.parquet(path)).collect()}
    assert {i: got[i].families for i in got} == {i: f for i, (_, f) in enumerate(CASES)}
    for i, (_, families) in enumerate(CASES):
        assert (got[i].family is not None) == bool(families) and (not families or got[i].family in families.split(","))
    assert got[len(CASES) - 2].n_paragraphs == 0 and got[0].n_paragraphs == 1 and got[9].n_paragraphs == 2


def brute(text):
    """Families by plain Python: the same windows, model and comparison."""
    families, bias, weights = L.train()
    anchor, lines, out = re.compile(L.ANCHORS, re.A), (text or "").split("\n"), set()
    for i, line in enumerate(lines):
        if not anchor.search(line):
            continue
        low, high = i, i + 1
        while low and lines[low - 1].strip(" "):
            low -= 1
        while high < len(lines) and lines[high].strip(" "):
            high += 1
        for start, n in [*((i - before, n) for before, n in L.RUNS), (low, high - low)]:
            part = lines[max(0, start) : start + n]
            if start < 0 or start + n > len(lines) or (n > 1 and (len(" ".join(part)) > L.LONGEST or any(not x.strip(" ") for x in part))):
                continue
            words = L.words_of(" ".join(part))
            fs = L.features_of(words)
            z = [b + sum(weights[f][k] for f in fs if f in weights) / math.sqrt(len(fs)) for k, b in enumerate(bias)] if fs & weights.keys() else None
            if z is None:
                continue
            e = [math.exp(v - max(z)) for v in z]
            pairs = {" ".join(p) for p in zip(words, words[1:])}
            for k, name in enumerate(families[:-1]):
                if 1 - e[-1] / sum(e) >= L.MIN_KNOWN and e[k] / sum(e) >= L.MIN_PROBABILITY:
                    for other, notice, own in L.templates():
                        least = (L.SHORT_COVER if len(notice) < L.SHORT else L.MIN_COVER) * len(notice)
                        if other == name and len(pairs & set(notice)) >= least and pairs & set(own) and not pairs & set(L.DENYING):
                            out.add(name)
    return ",".join(sorted(out))


def test_is_brute_force(spark, docs, edge, empty, tmp_path):
    for df in (docs, edge):
        want = sorted((str(r.doc_id), brute(r.text)) for r in df.collect())
        assert sorted((str(r.doc_id), r.families) for r in L.scan_licenses(df).collect()) == want
    for text, families in CASES:
        assert brute(text) == families
    assert L.scan_licenses(empty).count() == 0


def test_each_notice_has_an_anchor():
    assert all(re.search(L.ANCHORS, t) for _, t in L.NOTICES) and all(own for *_, own in L.templates())


def test_planted_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = re.compile(r"licensed under|under the MIT License|All rights reserved", re.I)
    for r in L.scan_licenses(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert (r.family is not None) == bool(lines.search(r.text))


HELD_OUT = [
    ("You can redistribute this package under the terms of the GNU General Public License v2.", "GPL"), ("This font tool is distributed under the MIT License, see the file.", "MIT"),
    ("The project is licensed under the Apache License 2.0, unless stated.", "Apache-2.0"), ("All code here is released under the LGPL v3.", "LGPL"), ("The server is available under the AGPLv3.", "AGPL"),
    ("This module is covered by and licensed under the Mozilla Public License 2.0.", "MPL-2.0"), ("Photos are licensed under CC BY-SA 4.0 by their authors.", "CC-BY-SA"), ("Texts are licensed under CC BY 4.0.", "CC-BY"),
    ("# SPDX-License-Identifier: ISC", "ISC"), ("/* SPDX-License-Identifier: Zlib */", "Zlib"), ("-- SPDX-License-Identifier: GPL-2.0-or-later --", "GPL"), ("Copyright 2011 by Ann Roe. All rights reserved worldwide.", "Proprietary"),
    ("The library isn't available under the LGPL.", ""), ("The tool was never released under the GPL.", ""), ("Driving without a licence is not allowed.", ""), ("The Mozilla office closed last year.", ""),
    ("He reserved the right to reply.", ""), ("Permission was asked and not given.", ""), ("Attribution of the painting is disputed.", ""), ("A solar eclipse was seen in the north.", ""),
    ("The warranty covers parts for two years.", ""), ("Licensed under the Microsoft Public License.", ""), ("Our proprietary recipe is kept confidential.", ""), ("The gnu grazes in herds.", "")]


def test_held_out_texts_have_no_wrong_family():
    """None of these is among the texts of the training."""
    assert not {t for t, _ in HELD_OUT} & ({t for _, t in L.NOTICES} | set(L.OTHERS))
    got = [(t, f, brute(t)) for t, f in HELD_OUT]
    assert not [x for x in got if x[2] not in ("", x[1])]
    assert sum(f == g for _, f, g in got) >= 0.9 * len(got)
