"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import bisect
import functools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batches import map_texts, texts_of

# Fixed texts: notices and grants as their publishers word them.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ),
    "lgpl-3.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) "
        "any later version.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
}
COVERAGE = 0.8
WHOLE = 10  # templates of fewer words must be found whole: one word more or less is another license
# What tells a license from its relatives: a stretch must hold one phrase of each group, word by word.
TELLING = {
    "apache-2.0": (("apache license version 2.0", "http://www.apache.org/licenses/license-2.0", "https://www.apache.org/licenses/license-2.0"),),
    "mit": (("mit license", "this permission notice"),),
    "bsd": (("redistributions in binary form",),),
    "isc": (("permission notice appear",),),
    "gpl-3.0": (("gnu general public license",), ("version 3",)),
    "lgpl-3.0": (("gnu lesser general public license",), ("version 3",)),
    "mpl-2.0": (("mozilla public license",), ("v 2.0", "version 2.0", "http://mozilla.org/mpl/2.0/", "https://mozilla.org/mpl/2.0/")),
    "cc-by-4.0": (("creative commons attribution 4.0", "cc by 4.0"),),
    "cc-by-nc-4.0": (("creative commons attribution-noncommercial 4.0", "cc by-nc 4.0"),),
    "cc-by-sa-4.0": (("creative commons attribution-sharealike 4.0", "cc by-sa 4.0"),),
}
# Words that say nothing about a license; they are aligned, but do not call for an alignment.
COMMON = frozenset(
    "a above all an and any are as at be by can copies copy copyright file files following for form free from if in is it later law may met "
    "must not of on one or other person program required see shall source subject that the this to under use was with work you your".split()
)
EDGES = ".,;:!?\"'()[]{}<>*#|`“”„«»"


def tokens(text: str) -> list[str]:
    """Lower-case words without the signs around them."""
    return [w for word in text.lower().split() if (w := word.strip(EDGES))]


def longest_rising(values: list[int]) -> list[int]:
    """Indexes of a longest rising subsequence, by piles of cards."""
    tops, pile, below = [], [], []
    for i, value in enumerate(values):
        at = bisect.bisect_left(tops, value)
        tops[at : at + 1] = [value]
        pile[at : at + 1] = [i]
        below.append(pile[at - 1] if at else -1)
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def common_places(a: list[str], b: list[str]) -> list[int]:
    """Places in `a` of a longest common subsequence, a bit for each word of `a`, traced back row by row."""
    at: defaultdict[str, int] = defaultdict(int)
    for i, word in enumerate(a):
        at[word] |= 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for word in b:
        hits = rows[-1] & at.get(word, 0)
        rows.append(((rows[-1] + hits) | (rows[-1] - hits)) & full)

    def length(i: int, j: int) -> int:
        return i - (rows[j] & ((1 << i) - 1)).bit_count()

    found, i, j = [], len(a), len(b)
    while i and j:
        if length(i - 1, j) == length(i, j):
            i -= 1
        elif length(i, j - 1) == length(i, j):
            j -= 1
        else:
            found.append(i - 1)
            i, j = i - 1, j - 1
    return found[::-1]


def aligned(a: list[str], b: list[str]) -> list[int]:
    """Places in `a` of the words of `b` that a patience alignment finds there, ascending.

    Equal heads and tails are matched. Then words that occur once in both are anchors: those of a longest rising
    subsequence stay, and the gaps between them are aligned in the same way. A gap without an anchor is
    settled by its longest common subsequence.
    """
    found, work = [], [(0, len(a), 0, len(b))]
    while work:
        i, j, k, n = work.pop()
        while i < j and k < n and a[i] == b[k]:
            found.append(i)
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            found.append(j - 1)
            j, n = j - 1, n - 1
        if i == j or k == n:
            continue
        left, right = Counter(a[i:j]), Counter(b[k:n])
        at = {w: x for x, w in enumerate(a[i:j], i) if left[w] == 1 and right[w] == 1}
        pairs = [(at[w], y) for y, w in enumerate(b[k:n], k) if w in at]
        if not pairs:
            found += [i + x for x in common_places(a[i:j], b[k:n])]
            continue
        for index in longest_rising([x for x, _ in pairs]):
            x, y = pairs[index]
            work.append((i, x, k, y))
            found.append(x)
            i, k = x + 1, y + 1
        work.append((i, j, k, n))
    return sorted(found)


@functools.lru_cache(maxsize=8)
def _prepared(templates: tuple[tuple[str, tuple[str, ...]], ...]):
    listed = [(name, tokens(text)) for name, texts in templates for text in texts]
    calls: defaultdict[str, set[int]] = defaultdict(set)
    for i, (_, words) in enumerate(listed):
        for word in words:
            if word not in COMMON:
                calls[word].add(i)
    return listed, dict(calls), frozenset(calls)


def windows(hits: list[int], size: int, n: int) -> list[tuple[int, int]]:
    """Stretches of twice the template's length that cover the neighbourhood of all hits.

    They overlap by the template's length plus a quarter, so any occurrence with its few added words lies in one.
    """
    reach = size + size // 4 + 2
    out, at = [], 0
    while at < len(hits):
        begin = max(0, hits[at] - reach)
        stop = at
        while stop + 1 < len(hits) and hits[stop + 1] - hits[stop] <= reach:
            stop += 1
        end = min(n, hits[stop] + reach + 1)
        while True:
            out.append((begin, min(end, begin + 2 * reach)))
            if begin + 2 * reach >= end:
                break
            begin += reach
        at = stop + 1
    return out


def told(words: list[str], groups: tuple[tuple[str, ...], ...]) -> bool:
    """Whether `words` hold a phrase of each group."""
    line = f" {' '.join(words)} "
    return all(any(f" {phrase} " in line for phrase in group) for group in groups)


def find(text: str | None, templates=None, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, words aligned, first word, end word) of the best stretch of each license found in the text.

    Templates of fewer than `WHOLE` words count only if all their words are aligned, and the built-in ones only with what
    is `TELLING` of them. Licenses come by words aligned, then name. The places are those of the first and last aligned word. A stretch
    that overlaps a longer alignment of another license is left to that one; notices beside each other are found each.
    """
    listed, calls, vocabulary = _prepared(tuple((templates or TEMPLATES).items()))
    words = tokens(text or "")
    if vocabulary.isdisjoint(words):
        return []
    places: defaultdict[int, list[int]] = defaultdict(list)
    for at, word in enumerate(words):
        for i in calls.get(word, ()):
            places[i].append(at)
    best: dict[str, tuple] = {}
    for i, hits in places.items():
        name, template = listed[i]
        own = set(template)
        least = len(template) if len(template) < WHOLE else coverage * len(template)
        for begin, end in windows(hits, len(template), len(words)):
            part = words[begin:end]
            if sum(w in own for w in part) < least or not (templates or told(part, TELLING[name])):
                continue
            at = aligned(part, template)
            if len(at) >= least:
                entry = (len(at), len(at) / len(template), at[0] - at[-1], -begin - at[0], begin + at[-1] + 1)  # then the closest, the first
                best[name] = max(best.get(name, entry), entry)
    ranked = sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))
    out: list[tuple[str, float, int, int, int]] = []
    for name, (got, share, _, first, end) in ranked:
        if not any(a < end and -first < b and (got < more or share < wide) for _, wide, more, a, b in out):
            out.append((name, share, got, -first, end))
    return out


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict | None = None, coverage: float = COVERAGE) -> DataFrame:
    """`key, license, coverage, words_aligned, first_word, end_word, licenses` for every row.

    `license` is the one with most aligned words among those of whose template at least `coverage` (of a short one, all) is found in
    order, with the words that tell it from others; null if there is none, and then coverage and words are 0 and places null. Ties go to the larger coverage,
    then to the first name. Texts are read whole, in stretches around words that speak of a license. Null
    and empty texts have no license; repeated rows and null keys stay; other columns are ignored. No shuffle.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, license string, coverage double, words_aligned long, first_word long, end_word long, licenses array<string>"
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    names = ["license", "coverage", "words_aligned", "first_word", "end_word", "licenses"]

    def work(batch):
        out = []
        for body in texts_of(batch):
            got = find(body, templates, coverage)
            name, share, count, first, end = got[0] if got else (None, 0.0, 0, None, None)
            out.append((name, float(np.round(share, 9)), count, first, end, [g[0] for g in got]))
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column("_key"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["_key", *names]
        )

    return map_texts(rows, schema, work).withColumnRenamed("_key", key)
