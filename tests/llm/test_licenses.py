import math
import re

import duckdb
import pytest

from plumbago.llm import licenses
from plumbago.llm.entry import ORACLE_SQL, op9_licenses

SF = "/root/testdata/sf0.001"


def grams(t):
    w = re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c.isascii() else c for c in t)).strip().split(" ")
    return set(zip(w, w[1:], strict=False))


def brute(text):
    text = text or ""
    units = text.split("\n") + [p for p in re.split("\n(?:[^A-Za-z0-9\n]*\n)+", text) if "\n" in p]
    parts = [re.split("(?<=[.!?])[ \t\r\n]+", u) for u in units]
    units += [s for p in parts if len(p) > 1 for s in p]
    found = []
    for u in units:
        best = None
        for i, (name, notice) in enumerate(licenses.TEMPLATES):
            a, b = grams(u), grams(notice)
            d = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if d >= licenses.THRESHOLD and (best is None or d > best[0]):
                best = (d, -i, name)
        found += [best] if best else []
    if not found:
        return None, 0.0, "", 0
    n = len(found)
    if any(f[2] == licenses.INSTEAD[0] for f in found):
        found = [f for f in found if f[2] != licenses.INSTEAD[1]]
    top = max(found)
    return top[2], top[0], ",".join(sorted({f[2] for f in found})), n


GPL = next(n for i, n in licenses.TEMPLATES if i == "GPL-3.0" and n.startswith("This program"))
MIT = next(n for i, n in licenses.TEMPLATES if i == "MIT" and n.startswith("Permission"))
TEXTS = [
    None, "", "\n\n", "one", "Released under the MIT license", "x\nRELEASED under the MIT License!!\n  Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 2",
    "This work is licensed under the\nGNU General Public License,\nversion 3.\n\nOther text follows here.", "MIT License", "released under the mit license " * 400, MIT.replace(", to deal", ",\nto deal"), "Licensed under the Apache License, Version 2.0 with changes of our own made",
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], "x")], "doc_id long, text string, license string")
    got = {r[0]: tuple(r)[1:] for r in licenses.license_scan(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)} | {None: brute(TEXTS[4])}
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_repeated_ids_keep_to_their_texts(spark):
    df = spark.createDataFrame([(1, TEXTS[4]), (1, "nothing"), (1, TEXTS[4]), (None, "nothing"), (None, TEXTS[4])], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["license"]), r["n_units"]) for r in licenses.license_scan(df).collect())
    assert got == [("1", "MIT", 1), ("1", "MIT", 1), ("1", "None", 0), ("None", "MIT", 1), ("None", "None", 0)]


@pytest.mark.parametrize(
    "text,license",
    [
        ("# Copyright 2020 Jane Doe\n#\n# " + "\n# ".join(GPL.split(". ")) + "\n#\nimport os", "GPL-3.0"),
        ("Copyright 2020 Jane Doe. Released under the MIT License. And much more text on this line about something else.", "MIT"),
        ("/*\n * " + MIT.replace(", ", ",\n * ") + "\n *\n * THE SOFTWARE IS PROVIDED AS IS\n */", "MIT"),
    ],
)
def test_notices_in_comments_and_within_lines(spark, text, license):
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["license"] == license == brute(text)[0]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_telling_words_lose_nothing(threshold):
    words = set(licenses.telling(threshold=threshold))
    for _, notice in licenses.TEMPLATES:
        all_ = grams(notice)
        assert sum(not words & {*g} for g in all_) < math.ceil(len(all_) * threshold / (2 - threshold) - 1e-9)


def test_size_bounds_lose_nothing(spark):
    table = licenses.templates(spark).collect()
    for r in table:
        assert 2 * min(r["n"], r["notice_n"]) / (r["n"] + r["notice_n"]) >= licenses.THRESHOLD - 1e-9
    for i, (_, notice) in enumerate(licenses.TEMPLATES):
        n = len(grams(notice))
        sizes = {r["n"] for r in table if r["template"] == i}
        assert sizes == {k for k in range(1, 4 * n) if 2 * min(k, n) / (k + n) >= licenses.THRESHOLD - 1e-12}


def test_plan_has_no_python(spark):
    plan = op9_licenses(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op9_licenses"])
    assert sorted(map(str, op9_licenses(spark, SF).select(*want.columns).collect())) == sorted(f"Row({', '.join(f'{c}={v!r}' for c, v in zip(want.columns, r, strict=True))})" for r in want.fetchall())


GPL2 = "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
BSD += "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution."
BSD3 = BSD + "\n\n3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
HEADERS = [
    (GPL2, "GPL-2.0"), (GPL2.replace("\n", "\n * ").join(("/*\n * ", "\n */\nint x;")), "GPL-2.0"), (GPL2.replace("version 2", "version 3"), "GPL-3.0"), ("# " + GPL, "GPL-3.0"), (GPL.replace("This program", "Frobnicate"), "GPL-3.0"),
    (GPL2.replace("This program", "Frobnicate"), "GPL-2.0"), (GPL2.replace("; either version 2\nof the License, or (at your option) any later version", " version 2"), "GPL-2.0"), (GPL.replace("GNU General", "GNU Affero General"), "AGPL-3.0"),
    (GPL2.replace("General", "Lesser General").replace("program", "library").replace("version 2", "version 2.1"), "LGPL-2.1"), (GPL2.replace("General", "Lesser General").replace("program", "library").replace("version 2", "version 3"), "LGPL-3.0"),
    (BSD, "BSD-2-Clause"), (BSD3.format("the copyright holder"), "BSD-3-Clause"), (BSD3.format("Example Corporation"), "BSD-3-Clause"), ("// SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"), ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0"), ("Apache License\nVersion 2.0, January 2004", "Apache-2.0"), ("Licensed under GPL v2", "GPL-2.0"), ("Licensed under the GPLv3.", "GPL-3.0"),
    ("licensed under the GPL v2", "GPL-2.0"), ("MIT License\n\nCopyright (c) 2020 Jane Doe", "MIT"), ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', "MIT"),
    ("Mozilla Public License Version 2.0", "MPL-2.0"), ("Licensed under the LGPL v2.1", "LGPL-2.1"), ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"), ("The general public needs a license to fish in version 2 of the lake.", None),
]


def test_headers_get_their_own_licence(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HEADERS)], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["licenses"]) for r in licenses.license_scan(df).collect()}
    assert got == {i: (name, name or "") for i, (_, name) in enumerate(HEADERS)}
    assert [r["dice"] for r in licenses.license_scan(df.where("doc_id = 0")).collect()] == [1.0]


def test_ties_go_to_the_first_notice_and_long_texts_are_whole(spark):
    text = "word " * 200_000 + "\nReleased under the MIT License.\nLicensed under CC BY 4.0."
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["license"], row["licenses"], row["dice"]) == ("CC-BY-4.0", "CC-BY-4.0,MIT", 1.0)
