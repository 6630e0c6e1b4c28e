"""Licence scans: normalised text against licence templates, by Dice's coefficient over word bigrams.

Runs of ASCII characters other than letters and digits become one space (line feeds stay, and join a unit's lines as one
space, however many there are), and the rest is put in lower case. What is compared are a text's lines, its blocks (between blank lines) and the whole text, each different one once.
Dice's coefficient of n and m bigrams (with repeats) is at most 2 min(n, m) / (n + m), so a template is looked at only
where n lies between m t / (2 - t) and m (2 - t) / t for the threshold t; n follows from the number of words, before any
bigram is made. A unit must also have a key word: of a template's m bigrams, so many are keys that every match shares
one (all but c - 1, where c is the least number that a match shares), and the longer word of each is a key word. No
match is lost.

Everything is one projection over built-in functions: no shuffle, join or Python, whatever the input. The templates are
a list in the plan; many more than a few hundred would ask for a broadcast table.

Edge cases: null and empty texts, and units of fewer than two words, match nothing: n_units 0, licenses "", license and
score null. Ties in score go to the name that sorts first. Repeated rows get a row each; other columns are carried by
``scan``, which replaces columns named like those it adds.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least coefficient of a match.
THRESHOLD = 0.8

#: Licence names (SPDX) and notices or paragraphs that stand for them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_FSF = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {}, or (at your option) any later version."
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = [("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"), *((v, "International") for v in ("1.0", "2.0", "2.5", "3.0"))]
#: A paragraph that both licences open with.
BSD = "BSD-2-Clause OR BSD-3-Clause"

#: TEMPLATES and their neighbours, for scans where the best match of a unit names it (``best``).
NEIGHBOURS: list[tuple[str, str]] = [
    *((BSD if name == "BSD-2-Clause" else name, text) for name, text in TEMPLATES),
    *((f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons {name} {v} {form} License.") for kind, name in _CC.items() for v, form in _CC_VERSIONS),
    *((f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}.") for kind in _CC for v, _ in _CC_VERSIONS[:5]),
    *((f"{short}-{v}", f"This work is licensed under the GNU {name} Public License, version {v.removesuffix('.0')}.") for short, name, v in (("GPL", "General", "1.0"), ("GPL", "General", "2.0"), ("LGPL", "Library General", "2.0"), ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3.0"), ("AGPL", "Affero General", "3.0"))),
    ("GPL-1.0", _FSF.format("program", ";", "General Public License", ";", "1")),
    ("GPL-2.0", _FSF.format("program", ";", "General Public License", ";", "2 of the License")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.0", _FSF.format("library", ";", "Library General Public License", ";", "2 of the License")),
    ("LGPL-2.1", _FSF.format("library", ";", "Lesser General Public License", ";", "2.1 of the License")),
    ("LGPL-3.0", _FSF.format("program", ":", "Lesser General Public License", ",", "3 of the License")),
    ("AGPL-3.0", _FSF.format("program", ":", "Affero General Public License", ",", "3 of the License")),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
]

#: Names of columns that exist within the scan only.
_HITS, _ALL = "__licence_hits", "__licence_all"

#: What becomes a space: ASCII other than letters, digits and line feeds.
OTHER = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def bigrams(text: str) -> Counter[str]:
    """Word bigrams of one template or unit, with their numbers."""
    found = re.sub(OTHER, " ", text).lower().split()
    return Counter(f"{a} {b}" for a, b in zip(found, found[1:], strict=False))


def size_bounds(m: int, threshold: float) -> tuple[int, int]:
    """The least and largest number of bigrams that can reach the threshold against m."""
    return math.ceil(m * threshold / (2 - threshold) - 1e-9), math.floor(m * (2 - threshold) / threshold + 1e-9)


def key_bigrams(grams: Counter[str], threshold: float) -> list[str]:
    """So many of the bigrams (those with the longest words) that every match shares one of them."""
    m = grams.total()
    least = math.ceil(threshold * (m + size_bounds(m, threshold)[0]) / 2 - 1e-9)
    out, rest = [], m
    for g in sorted(grams, key=lambda g: (-max(map(len, g.split())), g)):
        if rest < least:
            break
        out.append(g)
        rest -= grams[g]
    return out


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def _units(text: Column, sentences: bool = False) -> Column:
    """Lines, blocks and the whole of a text (and its sentences), each different one once."""
    plain = F.regexp_replace(text, OTHER, " ")
    one_line = lambda u: F.trim(F.regexp_replace(u, "[ \n]+", " "))
    parts = [F.transform(F.split(plain, "\n"), lambda u: F.trim(u)), F.transform(F.split(plain, r"\n *\n"), one_line), F.array(one_line(plain))]
    if sentences:
        parts.append(F.transform(F.split(text, r"(?<=[.!?])\s+|\n\s*\n"), lambda t: one_line(F.regexp_replace(t, OTHER, " "))))
    return F.array_distinct(F.concat(*parts))


def _bigrams(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))


def scan(docs: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, best: bool = False, sentences: bool = False) -> DataFrame:
    """docs with n_units (units that match a template), licenses (names found, sorted, joined by commas), license and score (of the best match).

    With best (for NEIGHBOURS) a unit counts only under the names of its own best match, and the clause of BSD-3-Clause
    anywhere in a text decides what its BSD opening is. With sentences, a text's sentences are units too.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0, up to 1")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_units", "licenses", "license", "score")]
    known = [(name, grams, *size_bounds(grams.total(), threshold)) for name, grams in ((name, bigrams(text)) for name, text in templates) if grams]
    keys = sorted({max(g.split(), key=len) for _, grams, _, _ in known for g in key_bigrams(grams, threshold)})
    fewest, most = min(k[2] for k in known), max(k[3] for k in known)
    table = F.array(*(F.struct(F.lit(name).alias("name"), _array(grams).alias("grams"), _array(grams.values()).alias("times"), F.lit(grams.total()).alias("m"), F.lit(low).alias("low"), F.lit(high).alias("high")) for name, grams, low, high in known))
    # A unit has one space between two words and none at its ends, so it has as many spaces as bigrams.
    spaces = lambda u: F.octet_length(u) - F.octet_length(F.replace(u, F.lit(" "), F.lit("")))
    fitting = F.filter(_units(F.coalesce(F.col(text_col).cast("string"), F.lit("")), sentences), lambda u: (spaces(u) >= fewest) & (spaces(u) <= most))
    split = F.transform(fitting, lambda u: F.split(F.lower(u), " "))
    sized = F.filter(split, lambda w: F.arrays_overlap(w, _array(keys)))
    near = F.array_distinct(F.transform(sized, _bigrams))

    def matches(g: Column) -> Column:
        in_bounds = F.filter(table, lambda t: (F.size(g) >= t["low"]) & (F.size(g) <= t["high"]))

        def dice(t: Column) -> Column:
            shared = F.zip_with(t["grams"], t["times"], lambda b, c: F.least(c, F.size(F.filter(g, lambda x: x == b))))
            return F.lit(2.0) * F.aggregate(shared, F.lit(0), lambda a, b: a + b) / (F.size(g) + t["m"])

        rated = F.transform(in_bounds, lambda t: F.struct(dice(t).alias("dice"), t["name"].alias("name")))
        return F.filter(rated, lambda r: r["dice"] >= threshold)

    def own_best(m: Column) -> Column:
        return F.filter(m, lambda r: r["dice"] == F.array_max(F.transform(m, lambda x: x["dice"])))

    hits = F.filter(F.transform(near, matches), lambda m: F.size(m) > 0)
    found = docs.select(*own, hits.alias(_HITS))
    if best:
        found = found.withColumn(_HITS, F.transform(_HITS, own_best))
    found = found.withColumn(_ALL, F.flatten(_HITS))
    if best:
        told = F.exists(_ALL, lambda r: r["name"] == "BSD-3-Clause")
        found = found.withColumn(_ALL, F.transform(_ALL, lambda r: F.struct(r["dice"].alias("dice"), F.when(told & (r["name"] == BSD), "BSD-3-Clause").otherwise(r["name"]).alias("name"))))
    top = F.array_max(F.transform(_ALL, lambda r: r["dice"]))
    return found.select(
        *own,
        F.size(_HITS).cast("long").alias("n_units"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(_ALL, lambda r: r["name"]))), ",").alias("licenses"),
        F.array_min(F.transform(F.filter(_ALL, lambda r: r["dice"] == top), lambda r: r["name"])).alias("license"),
        top.alias("score"),
    )
