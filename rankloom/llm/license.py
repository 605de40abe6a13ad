r"""License scans: a trained paragraph classifier with a calibrated unknown class, confirmed by templates.

The classifier is a multinomial logistic regression over word 1- and 2-grams with an L1 penalty, so most
weights are zero; n-grams of stop words and digits alone are no features.  It is trained here, from the notices
below: cut, thinned and disturbed copies of them for each family, and for the class `unknown` word salad of the
same vocabulary, function words and mixtures of loose phrases.  A held-out part of these copies sets the
temperature of the probabilities.

Scanning uses only DataFrame functions, and each row is judged where it is: nothing is shuffled.  Units are the
paragraphs of the whole text (ends are blank lines), their sentences and clauses, also where these run over line
breaks, and the lines; each that is longer than `PART` words in parts of as many, half of which overlap.  So every
word of a text is scored, and several licences of one sentence stand in clauses of their own.  Of a paragraph, a
sentence or a line longer than that, whose clauses are units by themselves, no parts are taken.  The n-grams of a unit
add up to class scores and to overlaps with each template.  A unit is confirmed if its family is the likeliest,
at least `MIN_PROBABILITY` likely, and its n-grams cover at least `MIN_OVERLAP` of the smaller of itself and a
template of that family; else it is of the class `unknown`.  Sums are left out where a bound shows them to be in
vain, with no loss: a unit whose n-grams together lift no family above `unknown`, and first of all a text without
a word that any such unit must have (see `strong`).

Cue lines, lines with a word of `CUES`, are counted; one is confirmed alone, with the line before or with the next four.

Cases: null and empty texts have no unit; a text with several notices lists all families; of families that are
equally likely the last in order counts; repeated rows each get a row; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need
from .quality import let

MIN_PROBABILITY = 0.5
MIN_OVERLAP = 0.5
UNKNOWN = "unknown"
#: Words of a part of a long unit.
PART = 60
#: Ends of paragraphs, of sentences and of clauses.
PARAGRAPH, SENTENCE, CLAUSE = r"\n[ \t\r]*\n", r"(?<=[.!?;])\s+", r"[,:()/|]+|\b(?i:and|or)\b"
CUES = r"(?i)licen[sc]e|copyright|warrant|redistribut|permission is hereby|creative commons|public domain"

# Words that say nothing about a licence by themselves.
STOP = frozenset(
    "a an and any are as at be been but by for from had has have he if in into is it its may no not of on or our she so such that the their they this to was we were what when which who will with you your 0 1 2 3 4 5 6 7 8 9".split()
)

#: Words of the notices that are frequent in other languages or other matters.
FREQUENT = ("mit", "nd", "do", "und", "der", "dem", "er", "use", "used", "can", "work", "public", "general")

# The usual short notices and opening paragraphs of public licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Distributed under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-ND", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0", "Licensed under CC0 1.0 Universal."),
    ("CC0", "Licensed under CC0."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the Creative Commons CC0 1.0 Universal Public Domain Dedication."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL", "Licensed under the Eclipse Public License, version 2.0."),
    ("EPL", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at"),
    ("Unlicense", "Released under the Unlicense."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("GPL", "Distributed under the GNU GPL v3."),
    ("GPL", "Licensed under GPLv3."),
    ("GPL", "Released under the GNU GPL, version 2 or later."),
    ("GPL", "This program is licensed under the GPLv2 or the GPL version 3."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "Distributed under the GNU LGPL v3. Licensed under LGPLv3."),
    ("AGPL", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL", "Licensed under the AGPL v3. Released under the GNU AGPLv3."),
    ("MIT", "Licensed under the MIT license (MIT)."),
    ("MIT", "the MIT License"),
    ("Apache-2.0", "the Apache License"),
    ("Apache-2.0", "Licensed under Apache 2.0."),
    ("BSD", "the BSD License"),
    ("BSD", "Released under the 2-Clause BSD License. Licensed under the simplified BSD license."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0. Released under the MPL 2.0."),
    ("ISC", "the ISC License"),
    ("EPL", "Released under the EPL 2.0."),
    ("Zlib", "Released under the zlib License."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Artistic-2.0", "Released under the Artistic License 2.0."),
    ("CDDL", "The contents of this file are subject to the terms of the Common Development and Distribution License, version 1.0 (the CDDL)."),
    ("EUPL", "Licensed under the European Union Public Licence, version 1.2. Licensed under the EUPL."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("WTFPL", "Released under the WTFPL, the Do What The Fuck You Want To Public License."),
    ("CC-BY", "CC BY 4.0"),
    ("CC-BY-SA", "CC BY-SA 4.0"),
    ("CC0", "CC0 1.0"),
    *((f, x.format(n)) for f, n in [("MIT", "MIT"), ("Apache-2.0", "Apache 2.0"), ("BSD", "BSD"), ("MPL-2.0", "MPL 2.0"), ("ISC", "ISC"), ("EPL", "EPL 2.0"), ("Zlib", "zlib"), ("GPL", "GPL"), ("LGPL", "LGPL"), ("AGPL", "AGPL"), ("Unlicense", "Unlicense"), ("WTFPL", "WTFPL"), ("EUPL", "EUPL"), ("CDDL", "CDDL")] for x in ("{} License", "SPDX: {}")),
    *((f, f"SPDX-License-Identifier: {x}") for f, x in [("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL", "GPL-3.0-or-later"), ("LGPL", "LGPL-2.1-or-later"), ("AGPL", "AGPL-3.0-or-later"), ("BSD", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0"), ("ISC", "ISC"), ("EPL", "EPL-2.0"), ("CC0", "CC0-1.0"), ("Unlicense", "Unlicense"), ("Zlib", "Zlib"), ("BSL-1.0", "BSL-1.0")]),
]
LOOSE = [
    "all rights reserved", "the license of the driver", "a license to operate", "his driving licence was", "copyright of the song belongs to", "under the terms of the contract",
    "warranty for this product is two years", "permission to enter the site", "the software is slow", "version 2 of the report", "this work is in progress",
    "free of charge for members", "public library opening hours", "the foundation published a report", "creative commons room in the building", "licensed premises only",
    "mit", "mit dem zug", "er kam mit der bahn", "und mit einem", "researchers at mit", "the apache helicopter landed", "apache county", "free software conference", "open source software",
    "the general public", "general public library", "a public licence office", "subject to the terms of sale", "terms of service", "a driving license", "fishing license required", "license plate",
    "version 3 of the software", "use of this software", "the font is large", "boost your sales", "an artistic work", "eclipse of the sun", "the european union", "common development goals",
    "attribution of the painting", "international conference", "in no event", "neither the name nor the address", "made available to members", "permission was granted", "without limitation",
]
FAMILIES = sorted({f for f, _ in TEMPLATES})
CLASSES = [*FAMILIES, UNKNOWN]


def grams(text: str) -> set[str]:
    """Words and pairs of words, but for those of stop words alone."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return {w for w in words if w not in STOP} | {f"{a} {b}" for a, b in zip(words, words[1:]) if a not in STOP or b not in STOP}


VOCABULARY = sorted(set().union(*(grams(t) for _, t in TEMPLATES), *(grams(t) for t in LOOSE)))


def copies(seed: int, each: int = 14) -> list[tuple[str, str]]:
    """Disturbed copies of the notices with their family, and texts of class unknown."""
    rng = np.random.default_rng(seed)
    salad = [w for _, t in TEMPLATES for w in t.lower().split()]
    other = [*(f"w{i}" for i in range(200)), *(w for w in sorted(STOP) if w.isalpha())]
    out = []
    for family, text in TEMPLATES:
        size = len(text.split())
        for _ in range(each * max(1, size // 8)):  # long notices have more parts to learn
            words = text.lower().split()
            if size > 14 and rng.random() < 0.8:  # a part of the notice
                n = int(rng.integers(10, size))
                at = int(rng.integers(0, size - n + 1))
                words = words[at : at + n]
            if rng.random() < 0.4:  # another version
                words = ["".join(str(rng.integers(0, 10)) if c.isdigit() else c for c in w) for w in words]
            rate = 0.06 if len(words) > 5 else 0.0
            words = [w if rng.random() > rate else str(rng.choice(other)) for w in words if rng.random() > rate]
            before, after = (list(rng.choice(other, int(rng.integers(0, 12)))) for _ in "ab")
            out.append((family, " ".join([*before, *words, *after])))
    for _ in range(len(out)):
        parts = [str(rng.choice(LOOSE)) for _ in range(int(rng.integers(0, 3)))] + list(rng.choice(salad, int(rng.integers(1, 7)))) + list(rng.choice(other, int(rng.integers(0, 20))))
        rng.shuffle(parts)
        out.append((UNKNOWN, " ".join(parts)))
    return out


def _matrix(rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    at = {g: i for i, g in enumerate(VOCABULARY)}
    x = np.zeros((len(rows), len(VOCABULARY) + 1))
    x[:, -1] = 1
    for i, (_, text) in enumerate(rows):
        x[i, [at[g] for g in grams(text) if g in at]] = 1
    return x, np.array([CLASSES.index(c) for c, _ in rows])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(1)
def train(steps: int = 250, penalty: float = 5e-5) -> tuple[np.ndarray, float]:
    """Weights (vocabulary and a constant, by class) by accelerated proximal gradient, and the temperature."""
    x, y = _matrix(copies(1))
    target = np.eye(len(CLASSES))[y]
    rate = 4 * len(x) / np.linalg.norm(x, 2) ** 2
    w = v = np.zeros((x.shape[1], len(CLASSES)))
    for k in range(1, steps + 1):
        new = v - rate * x.T @ (softmax(x @ v) - target) / len(x)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        w, v = new, new + (k - 1) / (k + 2) * (new - w)
    x, y = _matrix(copies(2))
    scale = np.linspace(0.25, 4, 60)
    loss = [-np.log(softmax(x @ w / s)[np.arange(len(y)), y] + 1e-12).mean() for s in scale]
    return w, float(scale[int(np.argmin(loss))])


@lru_cache(1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """Weights of the vocabulary by class, and the constants, after the temperature, to four digits."""
    w, heat = train()
    w = np.round(w / heat, 4)
    return w[:-1], w[-1]


def gains() -> tuple[np.ndarray, float]:
    """How far each n-gram can lift any family above `unknown`, and how far the constants keep all families below."""
    w, constant = model()
    k = CLASSES.index(UNKNOWN)
    return np.maximum(np.delete(w, k, 1) - w[:, [k]], 0).max(1), float(constant[k] - np.delete(constant, k).max())


def strong() -> list[str]:
    """Words of which every unit that is confirmed has one.

    N-grams of other words and stop words lift no family above `unknown`, even all of them together.  Words that
    other languages use often come first, short ones next, as they would let many texts through.
    """
    w, constant = model()
    k = CLASSES.index(UNKNOWN)
    lift, room = np.maximum(np.delete(w, k, 1) - w[:, [k]], 0), constant[k] - np.delete(constant, k) - 1e-6
    words = sorted({x for g in VOCABULARY for x in g.split()} - STOP)
    by_word = {x: [i for i, g in enumerate(VOCABULARY) if x in g.split()] for x in words}
    weak = set(STOP)
    for x in sorted(words, key=lambda x: (x not in FREQUENT, len(x) > 2, lift[by_word[x]].max(1).sum())):
        more = lift[[i for i in by_word[x] if set(VOCABULARY[i].split()) <= weak | {x}]].sum(0)
        if (more < room).all():
            weak.add(x)
            room = room - more
    return [x for x in words if x not in weak]


def _texts(values) -> str:
    return ", ".join(f"'{x}'" for x in values)


def _numbers(values, kind: str) -> str:
    """A list of numbers as a constant that is computed once."""
    return f"cast(split('{','.join(f'{x:.10g}' for x in values)}', ',') as array<{kind}>)"


def _judged(words: str) -> str:
    """SQL: family, probability, overlap and `sure` of a list of words in lower case."""
    w, constant = model()
    lift, room = gains()
    has = [grams(t) for _, t in TEMPLATES]
    n_classes, n = len(CLASSES), len(CLASSES) + len(TEMPLATES)
    keys, values, starts = [], [], [0]  # of each n-gram: classes with their weights, then templates that have it
    for i, g in enumerate(VOCABULARY):
        mine = [(k, w[i, k]) for k in np.flatnonzero(w[i])] + [(n_classes + t, 1.0) for t, h in enumerate(has) if g in h]
        keys += [k for k, _ in mine]
        values += [v for _, v in mine]
        starts.append(len(keys))
    stop = _texts(sorted(STOP))
    pairs = f"if(size(ws) >= 2, transform(filter(sequence(0, size(ws) - 2), i -> not (get(ws, i) in ({stop}) and get(ws, i + 1) in ({stop}))), i -> concat(get(ws, i), ' ', get(ws, i + 1))), cast(array() as array<string>))"
    place = f"map_from_arrays(split('{','.join(VOCABULARY)}', ','), sequence(0, {len(VOCABULARY) - 1}))"
    found = f"transform(filter(gs, g -> g in ({_texts(VOCABULARY)})), g -> element_at({place}, g))"
    total = f"transform(sequence(0, {n - 1}), c -> aggregate(es, cast(0 as double), (a, e) -> if(get({_numbers(keys, 'int')}, e) = c, a + get({_numbers(values, 'double')}, e), a)))"
    entries = f"flatten(transform(ks, k -> if(get({_numbers(starts, 'int')}, k) < get({_numbers(starts, 'int')}, k + 1), sequence(get({_numbers(starts, 'int')}, k), get({_numbers(starts, 'int')}, k + 1) - 1), cast(array() as array<int>))))"
    best = f"array_max(transform(sequence(0, {n_classes - 1}), c -> struct(get(zs, c) + get({_numbers(constant, 'double')}, c) as z, c)))"
    mass = f"aggregate(sequence(0, {n_classes - 1}), cast(0 as double), (a, c) -> a + exp(get(zs, c) + get({_numbers(constant, 'double')}, c) - b.z))"
    owner = _numbers([CLASSES.index(f) for f, _ in TEMPLATES], "int")
    sizes = _numbers([len(h) for h in has], "int")
    overlap = f"coalesce(array_max(transform(filter(sequence(0, {len(TEMPLATES) - 1}), t -> get({owner}, t) = b.c), t -> get(zs, t + {n_classes}) / least(size(gs), get({sizes}, t)))), 0D)"
    names = f"split('{','.join(CLASSES)}', ',')"
    unknown = f"named_struct('family', '{UNKNOWN}', 'probability', cast(null as double), 'overlap', 0D, 'sure', false)"
    sure = f"b.c <> {CLASSES.index(UNKNOWN)} and p >= {MIN_PROBABILITY} and o >= {MIN_OVERLAP}"
    verdict = let(f"1 / {mass}", "p", let(overlap, "o", f"named_struct('family', get({names}, b.c), 'probability', p, 'overlap', o, 'sure', {sure})"))
    scored = let(entries, "es", let(total, "zs", let(best, "b", verdict)))
    lifted = f"aggregate(ks, cast(0 as double), (a, k) -> a + get({_numbers(np.ceil(lift * 1e4) / 1e4, 'double')}, k)) >= {room - 1e-6}"
    every = f"array_distinct(concat(filter(ws, x -> x not in ({stop})), {pairs}))"
    return let(words, "ws", let(every, "gs", let(found, "ks", f"if({lifted}, {scored}, {unknown})")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_cues, n_confirmed, n_unknown (long), `notices`: line, family, probability, overlap of each cue line, and `passages`: the families confirmed in any unit."""
    need(docs, "doc_id", "text")
    apart = "'[^a-z0-9]+'"
    said = _texts(strong())

    def speaks(words: str) -> str:
        return f"exists({words}, x -> x in ({said}))"

    lines = "split(text, '\\n')"
    cues = let(lines, "l", f"transform(filter(sequence(0, size(l) - 1), i -> get(l, i) rlike r'{CUES}'), i -> struct(i as line, array_distinct(array(get(l, i), concat_ws(' ', get(l, i - 1), get(l, i)), concat_ws(' ', slice(l, i + 1, 5)))) as forms))")
    sentences = f"flatten(transform(ps, p -> split(p, r'{SENTENCE}')))"
    clauses = f"flatten(transform(ss, s -> split(s, r'{CLAUSE}')))"

    def spoken(units: str) -> str:
        """Those of the units that speak, as words."""
        return f"filter(transform(array_distinct({units}), u -> array_remove(split(lower(u), {apart}), '')), u -> {speaks('u')})"

    step = PART // 2
    parted = f"filter(flatten(transform({spoken(clauses)}, u -> if(size(u) <= {PART}, array(u), transform(sequence(0, size(u) - {step} - 1, {step}), i -> slice(u, i + 1, {PART}))))), u -> {speaks('u')})"
    whole = f"filter({spoken(f'concat(ps, ss, {lines})')}, u -> size(u) <= {PART})"
    every = let(f"split(text, r'{PARAGRAPH}')", "ps", let(sentences, "ss", f"array_distinct(concat({whole}, {parted}))"))
    units = f"transform({every}, u -> struct(-1 as line, u as words))"
    forms = f"flatten(transform(cues, c -> transform(c.forms, f -> struct(c.line as line, array_remove(split(lower(f), {apart}), '') as words))))"
    no_cues, no_units = "cast(array() as array<struct<line:int,forms:array<string>>>)", "cast(array() as array<struct<line:int,words:array<string>>>)"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    judge = f"transform(concat({forms}, if({speaks(f'split(lower(text), {apart})')}, {units}, {no_units})), u -> struct(u.line as line, {_judged('u.words')} as v))"
    found = let(f"if(text rlike r'{CUES}', {cues}, {no_cues})", "cues", let(judge, "judged", "named_struct('cues', transform(cues, c -> c.line), 'judged', judged)"))
    # Of the forms of a line the surest counts.
    surest = "array_max(transform(filter(r.judged, j -> j.line = c), j -> struct(j.v.sure as sure, coalesce(j.v.probability, 0D) as probability, j.v.overlap as overlap, j.v.family as family)))"
    notice = let(surest, "b", f"struct(c as line, if(b.sure, b.family, '{UNKNOWN}') as family, b.probability as probability, b.overlap as overlap)")
    passages = "array_sort(array_distinct(transform(filter(r.judged, j -> j.line < 0 and j.v.sure), j -> j.v.family)))"
    done = rows.select("doc_id", F.expr(let(found, "r", f"named_struct('notices', transform(r.cues, c -> {notice}), 'passages', {passages})")).alias("r"))
    n_cues, n_confirmed = F.size("r.notices").cast("long"), F.size(F.filter("r.notices", lambda x: x["family"] != UNKNOWN)).cast("long")
    return done.select("doc_id", n_cues.alias("n_cues"), n_confirmed.alias("n_confirmed"), (n_cues - n_confirmed).alias("n_unknown"), "r.notices", "r.passages")


def digest(found: DataFrame) -> DataFrame:
    known = F.array_sort(F.array_distinct(F.concat(F.filter(F.transform("notices", lambda x: x["family"]), lambda x: x != UNKNOWN), "passages")))
    return found.select("doc_id", "n_cues", "n_confirmed", "n_unknown", F.array_join(known, ",").alias("families"))
