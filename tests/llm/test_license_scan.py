import re
from collections import Counter

import pytest

from chunkgraph.llm import license_scan as ls
from tests.conftest import SF_SMALL
from tests.llm.conftest import make_docs


def grams(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return Counter(zip(w, w[1:]))


TEMPLATES = [(n, grams(t)) for n, t in ls.TEMPLATES]


def model(text):
    """(license, dice, unit, n_matches) by comparing every unit with every template."""
    text = text or ""
    lines = text.split("\n")
    units = list(lines)
    if len(lines) > 1:
        paragraphs = re.split(r"\n[\x20\x09-\x0D]*\n", text)
        units += [p for p in paragraphs if "\n" in p] if len(paragraphs) > 1 else []
        units.append(text)
        units += ["\n\n".join(paragraphs[i:i + k]) for k in range(2, ls.RUN + 1)
                  for i in range(len(paragraphs) - k + 1) if len(paragraphs) > 1]
    best, n = None, 0
    for i, u in enumerate(units):
        g = grams(u)
        scores = [(-(g & t).total(), -2 * (g & t).total() / (g.total() + t.total()), name, i) for name, t in TEMPLATES
                  if g.total() + t.total()]
        scores = [s for s in scores if s[1] <= -ls.THRESHOLD]
        n += bool(scores)
        best = min([*scores, *([best] if best else [])], default=None)
    return (None, None, None, 0) if best is None else (best[2], round(-best[1], 6), best[3], n)


def got(df):
    return {r.doc_id: (r.license, r.dice, r.unit, r.n_matches) for r in df.collect()}


def test_query_on_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    out = got(ls.op5_license_scan(spark, SF_SMALL))
    assert out == {d: model(t) for d, t in docs.items()}
    assert any(v[0] for v in out.values())


MIT = next(t for n, t in ls.TEMPLATES if len(t) > 300)
EDGE = [None, "", "one", "All rights reserved.", "ALL RIGHTS\tRESERVED!!", "all rights not reserved",
        "Text.\nReleased under the MIT license\nAll rights reserved", "Licensed under the Apache Licence, Version 2.0",
        "\n".join(MIT.split(". ")), "Some words here.\n\n" + MIT.replace(", ", ",\n") + "\n\nmore words there",
        "word " * 60000, "a b " * 9, "Copyright\n" + MIT, "rights reserved all rights"]


def test_edge_texts(spark):
    assert got(ls.license_scan(make_docs(spark, EDGE))) == {i: model(t) for i, t in enumerate(EDGE)}


GPL = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General "
       "Public License as published by the Free Software Foundation; {}")
LATER = "either version {} of the License, or (at your option) any later version."
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MIT_TEXT = next(t for n, t in ls.TEMPLATES if n == "MIT" and len(t) > 900)
CODE = "\n".join(f"int value_{i} = compute({i});" for i in range(80))
NAMED = [
    ("GPL-2.0-or-later", GPL.format("", LATER.format("2"))), ("GPL-2.0-only", GPL.format("", "version 2 of the License.")),
    ("GPL-3.0-or-later", GPL.format("", LATER.format("3"))), ("GPL-3.0-only", GPL.format("", "version 3 of the License only.")),
    ("LGPL-2.1-or-later", GPL.format("Lesser ", LATER.format("2.1")).replace("program", "library")),
    ("AGPL-3.0-or-later", GPL.format("Affero ", LATER.format("3"))),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 International License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", BSD3), ("BSD-3-Clause", " ".join(BSD3.split())), ("BSD-2-Clause", BSD3[:BSD3.index("\n\n3.")]),
    ("BSD-3-Clause", f"Copyright 2019 the makers\n\n{BSD3}\n\n#include <all.h>\n\n{CODE}"),
    ("MIT", MIT_TEXT), ("MIT", f"// one\n\nMIT License\n\n{MIT_TEXT.replace('. ', chr(46) + chr(10) * 2)}\n\n{CODE}"),
    ("CC0-1.0", "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights "
                "to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, "
                  "modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as "
                  "a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GFDL-1.3-or-later", "Permission is granted to copy, distribute and/or modify this document under the terms of the "
                          "GNU Free Documentation License, Version 1.3 or any later version published by the Free "
                          "Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover "
                          "Texts. A copy of the license is included in the section entitled \"GNU Free Documentation "
                          "License\"."),
    ("Apache-1.1", next(t for n, t in ls.TEMPLATES if n == "Apache-1.1"))]


def test_versions_are_told_apart(spark):
    """Each template and each notice is named as its own licence, not as a near one."""
    cases = [*ls.TEMPLATES, *NAMED]
    out = got(ls.license_scan(make_docs(spark, [t for _, t in cases])))
    assert [out[i][0] for i in range(len(cases))] == [n for n, _ in cases]


def test_repeats_clashes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "all rights reserved", "x"), (1, "all rights reserved", "x"),
                                (None, "all rights reserved", "x")], "doc_id long, text string, license string")
    assert [r.license for r in ls.license_scan(df).collect()] == ["LicenseRef-AllRightsReserved"] * 3
    assert ls.license_scan(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(1, "All rights reserved"), (1, "Released under the MIT License"), (1, "nothing here")],
                               "doc_id long, text string")
    got = sorted((r.license or "", r.n_matches) for r in ls.license_scan(df).collect())
    assert got == [("", 0), ("LicenseRef-AllRightsReserved", 1), ("MIT", 1)]


def test_templates_are_an_argument(spark):
    own = [("Own-1.0", "You may read this page as often as you like, but only aloud and in the rain")]
    df = make_docs(spark, [own[0][1].upper(), "All rights reserved", "as often as you like"])
    assert [r.license for r in ls.license_scan(df, templates=own).orderBy("doc_id").collect()] == ["Own-1.0", None, None]


def test_marks_lose_no_match(spark):
    """Units at the very threshold, made by replacing words of a template."""
    import random
    rnd = random.Random(5)
    texts = []
    for _, t in ls.TEMPLATES[::4]:
        w = t.split()
        for share in (0.02, 0.05, 0.1, 0.15):
            x = list(w)
            for i in rnd.sample(range(len(x)), max(1, int(share * len(x)))):
                x[i] = rnd.choice(["of", "zebra", "the", x[0]])
            texts.append(" ".join(x))
    out = got(ls.license_scan(make_docs(spark, texts)))
    want = {i: model(t) for i, t in enumerate(texts)}
    assert out == want and 0 < sum(v[0] is None for v in want.values()) < len(want)


def test_size_bounds_drop_nothing():
    for size in range(1, 200):
        lo, hi = ls.size_bounds(size, 0.8)
        for other in range(1, 400):
            if 2 * min(size, other) / (size + other) >= 0.8:
                assert lo - 1e-9 <= other <= hi + 1e-9


@pytest.mark.parametrize("q", ["Python", "Arrow", "Cartesian"])
def test_plan_is_native(spark, q):
    assert q not in ls.op5_license_scan(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
