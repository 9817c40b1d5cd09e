"""Licence scan: lines, paragraphs and sentences against licence notices by the Dice coefficient of word bigrams.

Built-in functions only: whatever the plan does runs in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Licence id and the wording of a notice, a title, a header of a file or a clause that tells the licence.
NOTICES: tuple[tuple[str, str], ...] = (
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("MIT", 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Licence id and the short names by which files speak of it.
SHORT_NAMES = {"AGPL-3.0": ("AGPL v3", "AGPLv3"), "GPL-2.0": ("GPL v2", "GPLv2"), "GPL-3.0": ("GPL v3", "GPLv3"), "LGPL-2.1": ("LGPL v2.1", "LGPLv2.1"), "LGPL-3.0": ("LGPL v3", "LGPLv3"), "Apache-2.0": ("Apache 2.0",), "MIT": ("MIT license",)}
#: A clause that makes a licence of the clauses of another: where it stands, the other isn't named.
INSTEAD = ("BSD-3-Clause", "BSD-2-Clause")


def all_notices() -> tuple[tuple[str, str], ...]:
    """NOTICES, the SPDX line of each of their licences, and its short names after "licensed under"."""
    ids = sorted({license for license, _ in NOTICES})
    spdx = [(license, f"SPDX-License-Identifier: {license}") for license in ids]
    short = [(license, f"Licensed under {article}{name}.") for license, names in SHORT_NAMES.items() for name in names for article in ("", "the ")]
    return (*NOTICES, *spdx, *short)


TEMPLATES = all_notices()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Words that most texts hold, which tell little.
_COMMON = frozenset("a all an and any are by following for in is may not of or possible provided that the this to under use with work you".split())


def _words(col):
    """Runs of a-z and 0-9 after lower-casing A-Z, all else being a gap."""
    return F.split(F.trim(F.regexp_replace(F.translate(col, _UPPER, _LOWER), "[^a-z0-9]+", " ")), " ")


def _bigrams(words: str) -> str:
    return f"array_distinct(zip_with(slice({words}, 1, size({words}) - 1), slice({words}, 2, size({words}) - 1), (x, y) -> concat(x, ' ', y)))"


def templates(spark, notices: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each notice and each number of bigrams that a stretch near enough to it can have."""
    quoted = ", ".join("({}, '{}', '{}')".format(i, *(x.replace("\\", "\\\\").replace("'", "\\'") for x in row)) for i, row in enumerate(notices))
    rows = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(template, license, notice)").withColumn("w", _words(F.col("notice")))
    rows = rows.where("size(w) > 1").withColumn("grams", F.expr(_bigrams("w"))).withColumn("n", F.size("grams"))
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    bounds = F.sequence(F.ceil(F.col("n") * least - 1e-9).cast("int"), F.floor(F.col("n") * most + 1e-9).cast("int"))
    return rows.select("template", "license", F.col("grams").alias("notice_grams"), F.col("n").alias("notice_n"), F.explode(bounds).alias("n"))


def telling(notices: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every stretch at the threshold holds one at least.

    Such a stretch shares threshold / (2 - threshold) of a notice's bigrams or more. For each notice, its longest words,
    common ones last, are taken until fewer bigrams than that are free of them.
    """
    out: set[str] = set()
    for _, notice in notices:
        words = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in notice).split()
        grams = {*zip(words, words[1:], strict=False)}
        shared = math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
        taken: set[str] = set()
        for w in sorted({*words}, key=lambda w: (w not in out, w in _COMMON, -len(w), w)):
            if sum(not taken & {*g} for g in grams) < shared:
                break
            taken.add(w)
        out |= taken
    return sorted(out)


def stretches(text: Column) -> Column:
    """Lines; paragraphs of several lines, between lines without letter or digit; the sentences of either, where there
    are several."""
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, "\n([^A-Za-z0-9\n]*\n)+"), lambda p: F.instr(p, "\n") > 0)
    both = F.concat(lines, paragraphs)
    sentences = F.transform(both, lambda p: F.split(F.regexp_replace(p, "([.!?])[ \t\r\n]+", "$1\u0001"), "\u0001"))
    return F.concat(both, F.flatten(F.filter(sentences, lambda s: F.size(s) > 1)))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, digest, unit, template, license, dice) of each stretch at the threshold or above; digest: the text's MD5.

    Two sets of a and b bigrams have a Dice coefficient of at most 2 min(a, b) / (a + b); so a notice is a candidate
    only for stretches whose number of bigrams lies in its bounds. That is an equi-join on this number with a table
    of the notices, whose size is the parameter's and not the data's; it is broadcast. Stretches without a telling word
    can't match (see telling()) and are left out first.
    """
    table = templates(docs.sparkSession, notices, threshold)
    word = "|".join(telling(notices, threshold))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(F.rlike("text", F.lit(f"(?i)(?:{word})")))
    units = rows.select("id", F.md5("text").alias("digest"), F.posexplode(stretches(F.col("text"))).alias("unit", "line"))
    words = units.where(F.rlike("line", F.lit(f"(?i)(?:{word})"))).select("id", "digest", "unit", _words(F.col("line")).alias("w"))
    grams = words.where("size(w) > 1").select("id", "digest", "unit", F.expr(_bigrams("w")).alias("grams"))
    found = grams.withColumn("n", F.size("grams")).join(F.broadcast(table), "n")
    shared = F.size(F.array_intersect("grams", "notice_grams"))
    dice = 2.0 * shared / (F.col("n") + F.col("notice_n"))
    return found.select("id", "digest", "unit", "template", "license", dice.alias("dice")).where(F.col("dice") >= threshold)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, license (null: none), dice of the best match, licenses (all found, sorted, joined
    by commas), n_units long (lines, paragraphs and sentences that match).

    Each stretch counts for its best notice only; a tie goes to the notice that stands first, and of a document's
    stretches the best, then the first notice. Versions of a licence have notices of their own, so the words that differ
    decide between them. Where the first of INSTEAD is found, the second isn't named, and its stretches are left to it. Null and empty texts match nothing. Rows with one id keep to their own
    texts; a null id is an id like others. Other columns are ignored; an empty table gives an empty result.
    """
    best = matches(docs, id_col, text_col, notices, threshold).groupBy("id", "digest", "unit").agg(F.max(F.struct("dice", (-F.col("template")).alias("first"), "license")).alias("m"))
    telling_one, other = INSTEAD
    found = best.groupBy("id", "digest").agg(
        F.max("m").alias("any"), F.max(F.when(F.col("m.license") != other, F.col("m"))).alias("else"), F.array_sort(F.collect_set("m.license")).alias("names"), F.count("*").alias("n_units")
    )
    instead = F.array_contains("names", telling_one)
    found = found.select("id", "digest", F.when(instead, F.col("else")).otherwise(F.col("any")).alias("m"), F.concat_ws(",", F.when(instead, F.array_remove("names", other)).otherwise(F.col("names"))).alias("licenses"), "n_units")
    rows = docs.select(F.col(id_col).alias("key"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("own"))
    out = rows.join(found, rows["key"].eqNullSafe(found["id"]) & (F.col("own") == F.col("digest")), "left")
    return out.select(F.col("key").alias(id_col), F.col("m.license").alias("license"), F.coalesce("m.dice", F.lit(0.0)).alias("dice"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_units", F.lit(0)).alias("n_units"))
