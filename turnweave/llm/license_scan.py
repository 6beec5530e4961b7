"""Licence notices by word-bigram Dice coefficient against templates, with built-in functions only.

Every line of a text is normalised to words of letters and digits, A-Z read as a-z. Where two sets of bigrams have sizes
a and b, their Dice coefficient is at most 2 min(a, b) / (a + b); so only templates whose size is within those bounds
are compared, and lines too short or too long for every template are dropped first.

Notices that are wrapped over lines, or stand among other words, are found by windows of words over the whole text. A
window that matches has at least a template's size times dice / (2 - dice) of its bigrams, so of any larger number of
bigrams than it can lack one stands in the text: only texts with such an anchor, which one regular expression looks
for, are cut into words for this. A window need not begin or end with a bigram that its template lacks.

Licences of one family differ by a word or a number, which no bound on Dice sees. So a match holds, for every template of
another licence that one text could match as well, half of the bigrams that its own template has and the other lacks.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm._session import pinned

#: Licence notices, fixed values: the words by which each licence asks to be referred to, or its own opening words.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("proprietary", "All rights reserved."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Licensed under the ISC License."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)
#: A licence is not a text's own if the text has one of those named: its words are part of theirs. Of all: ``"*"``.
YIELDS = {"proprietary": ("*",), "BSD-2-Clause": ("BSD-3-Clause",)}
DICE = 0.8
#: Words that make a bigram a poor anchor; the choice of anchors decides the speed only.
COMMON = frozenset("a and any are as at by in is it of or that the this to under with you".split())


def bigrams(text: str) -> list[str]:
    """A template's bigrams, as the operator makes them of a line."""
    import re

    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def distinguishing(templates: list[tuple[int, str, list[str]]], dice: float = DICE) -> dict[int, list[list[str]]]:
    """For each template (number, licence, bigrams) the lists of which a match holds half or more.

    There is one for each template of another licence that a text could match as well: Jaccard distances obey the
    triangle inequality, so the two templates' own Dice is bounded from below. A template that another one holds whole
    has nothing to tell the two apart and no list for it.
    """
    jaccard = 2 * dice / (2 - dice) - 1
    both = 2 * jaccard / (1 + jaccard) - 1e-9
    found = {}
    for n, name, own in templates:
        lists = [[g for g in own if g not in other] for _, rival, other in templates if rival != name and 2 * len(set(own) & set(other)) >= both * (len(own) + len(other))]
        found[n] = [list(x) for x in dict.fromkeys(map(tuple, lists)) if x]
    return found


def _array(items: list[str], kind: str) -> str:
    return f"array({', '.join(items)})" if items else f"cast(array() AS array<{kind}>)"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _telling(lists: list[list[str]]) -> str:
    return _array([_array([_quoted(g) for g in own], "string") for own in lists], "array<string>")


def _licence_of(notices: str, names: list[str], yields: dict[str, tuple[str, ...]]) -> str:
    """SQL for the notice that decides a text's licence: of the greatest dice, then the first."""
    kept = notices
    for name in sorted(set(names) & set(yields)):
        over = "true" if "*" in yields[name] else f"x.licence IN ({', '.join(map(_quoted, yields[name]))})"
        kept = f"filter({kept}, m -> m.licence <> {_quoted(name)} OR NOT exists({notices}, x -> x.licence <> {_quoted(name)} AND {over}))"
    return f"get(array_sort({kept}, (x, y) -> CASE WHEN x.dice > y.dice THEN -1 WHEN x.dice < y.dice THEN 1 ELSE x.line - y.line END), 0)"


def needed(size: int, dice: float = DICE) -> int:
    """Bigrams of a template of so many that a match has at least."""
    return math.ceil(size * dice / (2 - dice) - 1e-9)


def anchors(grams: list[str], dice: float = DICE) -> list[str]:
    """One bigram more than a match can lack, rare ones first."""
    rare_first = sorted(grams, key=lambda g: (len(COMMON.intersection(g.split())), -len(g)))
    return rare_first[: len(grams) - needed(len(grams), dice) + 1]


def anchor_pattern(templates: list[list[str]], dice: float = DICE) -> str:
    """A regular expression that each text with a matching window contains, lower-cased."""
    seconds = defaultdict(set)
    for grams in templates:
        for first, second in (g.split() for g in anchors(grams, dice)):
            seconds[first].add(second)
    return "(?<![a-z0-9])(?:" + "|".join(f"{a}[^a-z0-9]++(?:{'|'.join(sorted(b))})" for a, b in sorted(seconds.items())) + ")(?![a-z0-9])"


def _passages(f: DataFrame, known: list[tuple], telling: dict[int, list[list[str]]], dice: float) -> DataFrame:
    """Adds ``_passages`` to (_text, _found): matching windows, none of which shares a word with a better one."""
    # every column that a lambda refers to is pinned, or each element would compute it anew
    step = lambda f, name, sql: f.withColumn(name, pinned(F.expr(sql)))
    grams = list(dict.fromkeys(g for k in known for g in k[3]))
    low = F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = f.withColumn("_low", pinned(F.when(low.rlike(anchor_pattern([k[3] for k in known], dice)), low)))
    f = step(f, "_by_line", "transform(split(_low, '\n', -1), l -> filter(split(l, '[^a-z0-9]+'), w -> w <> ''))")
    f = step(f, "_at", "flatten(transform(_by_line, (ws, i) -> array_repeat(i, size(ws))))")
    f = step(f, "_words", "flatten(_by_line)")
    f = step(f, "_grams", "transform(slice(_words, 2, size(_words)), (w, i) -> concat(_words[i], ' ', w))")
    f = step(f, "_here", f"array_intersect(_grams, {_array([_quoted(g) for g in grams], 'string')})")
    f = step(f, "_met", "filter(transform(_grams, (g, i) -> named_struct('i', i, 'g', g)), x -> array_contains(_here, x.g))")
    # templates of which the text has enough, and where
    listed = ", ".join(f"named_struct('n', {n}, 'size', {size}, 'need', {needed(size, dice)}, 'most', {math.floor(size * (2 - dice) / dice + 1e-9)}, 'telling', {_telling(telling[n])}, 'own', {_array([_quoted(x) for x in g], 'string')})" for size, n, _, g in known)
    f = step(f, "_near", f"filter(transform(array({listed}), t -> named_struct('n', t.n, 'size', t.size, 'need', t.need, 'most', t.most, 'telling', t.telling, 'own', array_intersect(_here, t.own))), t -> size(t.own) >= t.need AND forall(t.telling, d -> 2 * size(array_intersect(d, t.own)) >= size(d)))")
    f = step(f, "_near", "transform(_near, t -> named_struct('n', t.n, 'size', t.size, 'need', t.need, 'most', t.most, 'telling', t.telling, 'met', filter(_met, x -> array_contains(t.own, x.g))))")
    # from each of those places, the places up to the longest window's end
    f = step(
        f,
        "_from",
        """flatten(transform(_near, t -> filter(transform(t.met, (x, k) -> named_struct('n', t.n, 'size', t.size, 'need', t.need, 'telling', t.telling, 'i', x.i,
             'met', filter(slice(t.met, k + 1, t.most), y -> y.i < x.i + t.most))), s -> size(s.met) >= s.need AND size(array_distinct(s.met.g)) >= s.need)))""",
    )
    f = step(
        f,
        "_from",
        """transform(_from, s -> array_max(transform(filter(sequence(s.need, size(s.met)), e -> forall(s.telling, d -> 2 * size(array_intersect(d, slice(s.met.g, 1, e))) >= size(d))), e -> named_struct(
             'dice', 2D * size(array_distinct(slice(s.met.g, 1, e))) / (s.size + size(array_distinct(slice(_grams, s.i + 1, s.met[e - 1].i - s.i + 1)))),
             'size', s.size, 'n', -s.n, 'i', -s.i, 'end', -s.met[e - 1].i))))""",
    )
    # the best first; a window's words are those from i to end + 1
    best = f"""aggregate(sort_array(filter(_from, w -> w.dice >= {dice}D), false), filter(_from, w -> false),
                 (kept, w) -> IF(exists(kept, k -> -k.i <= -w.end + 1 AND -w.i <= -k.end + 1), kept, array_append(kept, w)))"""
    f = step(f, "_from", best)
    names = "CASE -w.n " + " ".join(f"WHEN {n} THEN {_quoted(name)}" for _, n, name, _ in known) + " END"
    f = step(f, "_from", f"transform(_from, w -> named_struct('line', _at[-w.i], 'place', -w.i, 'last', _at[-w.end + 1], 'template', -w.n, 'licence', {names}, 'dice', w.dice))")
    # a line that is a notice of the same licence has told of it already
    rest = "filter(_from, w -> NOT exists(_found, m -> m.licence = w.licence AND m.line BETWEEN w.line AND w.last))"
    rest = f"transform(array_sort({rest}, (x, y) -> x.place - y.place), w -> named_struct('line', w.line, 'template', w.template, 'licence', w.licence, 'dice', w.dice))"
    none = "cast(array() AS array<struct<line: int, template: int, licence: string, dice: double>>)"
    return step(f, "_passages", f"coalesce({rest}, {none})")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dice: float = DICE, templates: tuple[tuple[str, str], ...] = TEMPLATES, yields: dict[str, tuple[str, ...]] = YIELDS) -> DataFrame:
    """One row per input row: ``id_col, licence, dice, notices, passages``.

    ``notices`` lists (line, template, licence, dice), the line counted from 0, of each line's best template with at
    least ``dice`` and the bigrams that tell it from other licences (``distinguishing``); of equal ones the smallest,
    then the first. ``licence`` and ``dice`` are those of the best line, the first of equal ones, or null; licences that
    give way to another one in the text (``yields``) are not compared. A null or empty text has no lines that match. Repeated rows and rows without an id are scanned each;
    an empty table gives an empty result; other columns are ignored. The scan is the only stage.

    ``passages`` lists in the same form, by place, what lines alone do not show: windows of the text's words, within a
    line or over several, of as many bigrams as the bound allows (repeats counted), that match as lines do. Of windows
    that share a word the best counts: the one of the greatest dice, then of the larger template, then of the first
    template, then the earlier one, then the shorter one. The line is that of its first word. A window that touches a
    line in ``notices`` with the same licence is left out.
    """
    known = sorted((len(bigrams(t)), n, name, bigrams(t)) for n, (name, t) in enumerate(templates) if bigrams(t))
    # a + b <= 2 min(a, b) / dice bounds the size of what can match
    slack = 1e-9  # so that rounding drops no size at the bounds
    low, high = min(k[0] for k in known) * dice / (2 - dice) - slack, max(k[0] for k in known) * (2 - dice) / dice + slack
    telling = distinguishing([(n, name, grams) for _, n, name, grams in known], dice)
    listed = ", ".join(f"named_struct('size', {size}, 'template', {n}, 'licence', {_quoted(name)}, 'telling', {_telling(telling[n])}, 'bigrams', {_array([_quoted(g) for g in grams], 'string')})" for size, n, name, grams in known)
    f = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("_lines"))
    f = f.withColumn("_lines", F.expr("transform(_lines, (l, i) -> named_struct('line', i, 'text', l))"))
    f = f.withColumn("_lines", F.expr(f"filter(_lines, l -> char_length(l.text) > {low}D)"))
    f = f.withColumn("_lines", F.expr("transform(_lines, l -> named_struct('line', l.line, 'words', filter(split(translate(l.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), w -> w <> '')))"))
    # n words have n - 1 bigrams at most, and n different words n - 1 different bigrams at least
    f = f.withColumn("_lines", F.expr(f"filter(_lines, l -> size(l.words) - 1 >= {low}D AND (size(l.words) - 1 <= {high}D OR size(array_distinct(l.words)) - 1 <= {high}D))"))
    f = f.withColumn("_lines", F.expr("transform(_lines, l -> named_struct('line', l.line, 'bigrams', array_distinct(transform(slice(l.words, 2, size(l.words)), (w, i) -> concat(l.words[i], ' ', w)))))"))
    f = f.withColumn("_lines", F.expr(f"filter(_lines, l -> size(l.bigrams) BETWEEN {low}D AND {high}D)"))
    f = f.withColumn("_known", F.expr(f"array({listed})"))
    compared = f"""transform(_lines, l -> aggregate(
        filter(_known, t -> {dice}D * (t.size + size(l.bigrams)) <= 2 * least(t.size, size(l.bigrams)) + {slack}D AND forall(t.telling, d -> 2 * size(array_intersect(d, l.bigrams)) >= size(d))),
        named_struct('line', l.line, 'template', -1, 'licence', cast(null AS string), 'dice', 0D),
        (best, t) -> IF(2D * size(array_intersect(l.bigrams, t.bigrams)) / (t.size + size(l.bigrams)) > best.dice,
                        named_struct('line', l.line, 'template', t.template, 'licence', t.licence, 'dice', 2D * size(array_intersect(l.bigrams, t.bigrams)) / (t.size + size(l.bigrams))), best)))"""
    f = f.withColumn("_found", pinned(F.expr(f"filter({compared}, m -> m.dice >= {dice}D)")))
    f = _passages(f, known, telling, dice)
    f = f.withColumn("_best", pinned(F.expr(_licence_of("_found", [k[2] for k in known], yields))))
    return f.select(F.col("_id").alias(id_col), F.col("_best.licence").alias("licence"), F.col("_best.dice").alias("dice"), pinned(F.col("_found")).alias("notices"), "_passages").withColumnRenamed("_passages", "passages")


def notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dice: float = DICE, templates: tuple[tuple[str, str], ...] = TEMPLATES, yields: dict[str, tuple[str, ...]] = YIELDS) -> DataFrame:
    """One row per input row: ``id_col, licence, dice, notices``, as ``scan`` gives them but of lines and passages.

    ``notices`` are ordered by line, a line's own before passages that begin there.
    """
    f = scan(docs, id_col, text_col, dice, templates, yields)
    f = f.withColumn("_all", pinned(F.expr("transform(concat(notices, passages), (m, i) -> named_struct('line', m.line, 'nth', i, 'template', m.template, 'licence', m.licence, 'dice', m.dice))")))
    f = f.withColumn("_all", pinned(F.expr("array_sort(_all)")))
    f = f.withColumn("_best", pinned(F.expr(_licence_of("_all", [name for name, t in templates if bigrams(t)], yields))))
    whole = F.expr("transform(_all, m -> named_struct('line', m.line, 'template', m.template, 'licence', m.licence, 'dice', m.dice))")
    return f.select(id_col, F.col("_best.licence").alias("licence"), F.col("_best.dice").alias("dice"), pinned(whole).alias("notices"))
