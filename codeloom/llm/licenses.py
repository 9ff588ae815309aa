"""License scans: a sparse word n-gram logistic regression over paragraphs, run by DataFrame functions only.

A paragraph is a window of up to LINES lines that follow each other without a blank line between them, so a notice
is met whole whether it is wrapped or not. Each family has a logistic regression of its own, so a paragraph may name several,
and unknown has one too. Of windows that overlap, the one that shares most n-grams with a template stays.
"""

from __future__ import annotations

import functools
import json
import random
import re

import numpy as np
from pyspark.sql import functions as F

from .common import table

#: Short texts by licence family, fixed values: notices that name a licence, and sentences of its text.
TEMPLATES = {
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "This work is licensed under the AGPL license version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.", "You should have received a copy of the GNU Affero General Public License along with this program.", "Distributed under the AGPL."),
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, without warranties or conditions of any kind", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License.", "Distributed under Apache 2.0."),
    "bsd": ("Released under the BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "Distributed under the BSD terms."),
    "cc-by": ("This work is licensed under the Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Licensed under CC BY 3.0."),
    "cc-by-nc": ("This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 3.0."),
    "cc-by-sa": ("This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal, no rights reserved, license of the public domain.", "SPDX-License-Identifier: CC0-1.0"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under the GPL license, version 2.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "Distributed under the GPL."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1", "Licensed under the LGPL license version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.", "You should have received a copy of the GNU Lesser General Public License along with this library.", "Distributed under the LGPL."),
    "mit": ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT", "Distributed under the MIT terms."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved.", "Copyright, all rights reserved.", "This document is proprietary and confidential; no license is granted and unauthorized copying is prohibited, copyright of the owner."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"),
}
#: Names of each family as short forms have them, fixed values.
NAMES = {
    "agpl": ("AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "GNU AGPL v3", "GNU Affero General Public License"),
    "apache": ("Apache", "Apache-2.0", "Apache 2.0", "Apache License 2.0", "ASL 2.0", "Apache License, Version 2.0"),
    "bsd": ("BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD 2-Clause", "BSD 3-Clause", "New BSD", "Simplified BSD"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "CC-BY-3.0", "Creative Commons Attribution", "Creative Commons Attribution 4.0 International"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution NonCommercial"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution ShareAlike"),
    "cc0": ("CC0", "CC0-1.0", "CC0 1.0", "CC0 1.0 Universal"),
    "gpl": ("GPL", "GPLv2", "GPLv3", "GPL v2", "GPL v3", "GPL-2.0", "GPL-3.0", "GPL-2.0-or-later", "GPL-3.0-or-later", "GPL-3.0-only", "GNU GPL", "GNU GPL v3", "GNU GPL v2", "GNU GPL v3 or later", "GNU General Public License"),
    "isc": ("ISC",),
    "lgpl": ("LGPL", "LGPLv2.1", "LGPLv3", "LGPL v3", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-or-later", "GNU LGPL", "GNU LGPL v3", "GNU Lesser General Public License"),
    "mit": ("MIT", "MIT/X11", "Expat"),
    "mpl": ("MPL", "MPL 2.0", "MPL-2.0", "MPLv2", "Mozilla Public License", "Mozilla Public License 2.0"),
    "unlicense": ("Unlicense", "The Unlicense"),
}
#: Names that are words elsewhere: they confirm nothing unless a word of CARRIERS is in the paragraph too.
PLAIN = {"Apache", "ASL 2.0", "BSD", "New BSD", "CC0", "Creative Commons Attribution", "Expat", "ISC", "MIT", "MIT/X11", "MPL"}
CARRIERS = ("license", "licence", "licensed", "licenced", "licenses", "spdx-license-identifier", "released under", "distributed under", "available under", "provided under", "published under")
#: Forms that grant, and forms that don't; the last ones of each are held out of the fit and set the temperature.
GRANTS = (
    "licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "released under the {} license", "distributed under the {} license", "distributed under {}", "license: {}", "licence: {}", "{} licensed",
    "this project is {} licensed", "{} license", "{} licence", "SPDX-License-Identifier: {}", "available under the terms of the {} license", "this software is available under the {}", "licensed under the terms of the {}", "dual licensed under {}", "this file is licensed under {} terms",
    "all code here is under the {} license", "this package is released under the terms of the {} licence", "governed by the {} license", "covered by the {}", "{} license terms",
    "license {}", "published under {}", "this work is licensed under a {} license", "provided under the {} license",
)
REFUSALS = (
    "not licensed under {}", "not licensed under the {} license", "this is not licensed under the {}", "not released under the {} license", "this file is not under the {} license", "no longer licensed under {}", "no longer released under the {}", "never licensed under {}", "we did not release it under {}", "they do not license this under the {}", "we don't publish it under {}", "not distributed under {}", "is not available under the {} license",
    "is not {} licensed", "not under the {} license", "not covered by the {} license", "isn't licensed under the {} license", "isn't released under {}", "not a {} license", "not {} licensed", "cannot be licensed under {}", "never released under the {} license", "was never distributed under the {} license",
)
#: What turns a grant that begins with licensed, released and the like into none.
NEGATIONS = ("not", "no longer", "never", "is not", "isn't", "was not", "wasn't", "cannot be", "can not be", "was never", "are not", "aren't")
BARE = (
    "we read about {} in the news", "they flew with {} to the city", "{} was the talk of the day", "students at {} read", "he spoke of {} and left", "we moved from {} to another one last year", "upgrade from {} first",
    "the {} campus has a licensed bar", "the {} team lost its license to sell food", "she got a fishing license and went to {}",
)
#: Forms that are headings, not grants, where a paragraph is only one of them with a name in PLAIN.
ALONE = ("{} license", "{} licence")
UNKNOWN = "unknown"
FAMILIES = (*sorted(TEMPLATES), UNKNOWN)
#: Sentences with licence words that grant nothing; the unknown class learns from these and from mixtures.
OTHER = (
    "The driver showed a licence at the border.", "The city issues a fishing license each spring and the fee is small.", "Copyright law is a field that students of public policy read about.", "Her licensed practice has been open for years.",
    "The warranty covers parts for two years.", "They reserved all the seats.", "Permission to enter is given by the guard.", "The public library has a new general reading room.", "We redistribute food to the poor in the city.", "The rights of all are reserved in the old law of the land.",
    "It was released under the old name in the spring.", "He works under the terms of a new contract.", "A license is needed to sell this in the market.", "The apache helicopter landed.", "Students at mit read about the gnu in the wild.",
)
#: Words that tell nothing alone: n-grams of these only are not in the vocabulary.
COMMON = set("a above all along an and any are as at author be being but by can copies copy except extent file following for forms free from general granted have in is it law may met must names no nor not obtaining of on or person program promote provided public purpose related retain right see shall should software source subject terms text that the their this to under use version will with without work you".split())
#: Words of the templates that are frequent elsewhere: a paragraph is picked by them only if a template leaves no other choice.
FREQUENT = COMMON | set("1.0 2.0 3.0 4.0 agreed associated available binary charge code conditions contributors distributed fee fitness form included into its list modification modify notice received released rights".split())
WORD_PATTERN = r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]"
#: Longest n-gram; least calibrated probability; least share of a template's n-grams that confirms it.
LONGEST, LEAST_PROBABILITY, LEAST_COVER = 4, 0.6, 0.6
#: Most lines of a window; a line of more characters than WRAPPED is no part of a wrapped paragraph and stands alone.
LINES, WRAPPED = 6, 160


def ngrams(text):
    words = re.findall(WORD_PATTERN, text.lower())
    return {" ".join(words[i : i + n]) for n in range(1, LONGEST + 1) for i in range(len(words) - n + 1)}


def telling(gram):
    return not all(w in COMMON for w in gram.split())


def holds(gram, phrase):
    return f" {phrase} " in f" {gram} "


@functools.cache
def templates():
    """(family, n-grams, whether a carrier must be there too) of each template and name; then, of no family, headings, and last the carriers."""
    out = [(f, frozenset(g for g in ngrams(t) if telling(g)), False) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]
    out += [(f, frozenset(g for g in ngrams(n) if telling(g)), n in PLAIN) for f in sorted(NAMES) for n in NAMES[f]]
    out += [(None, frozenset(g for g in ngrams(a.format(n)) if telling(g)), False) for n in sorted(PLAIN) for a in ALONE]
    return [*out, (None, frozenset(CARRIERS), False)]


def headings():
    """Numbers and sizes of the headings among templates()."""
    return [(k, len(t)) for k, (f, t, _) in enumerate(templates()[:-1]) if f is None]


@functools.cache
def keys():
    """Words and pairs of words of which each template needs one: without them less than LEAST_COVER of its n-grams are left, so no text lacking all is confirmed.

    Names in PLAIN need a carrier, so the carriers are their keys. MIT is a word of German, so it is a key after "the" only.
    """
    found = {*CARRIERS, "the mit"}
    for family, own, carried_by in templates():
        while family and not carried_by and sum(not any(holds(g, k) for k in found) for g in own) >= LEAST_COVER * len(own):
            left = [g.split() for g in own if not any(holds(g, k) for k in found)]
            found.add(max(sorted({w for g in left for w in g} - {"mit"}), key=lambda w: (w not in FREQUENT, w not in COMMON, sum(w in g for g in left))))
    return sorted(found)


def alternatives(words):
    """A pattern for {word: what must follow it}, with common beginnings written once, so that most places fail at one character."""
    by: dict = {}
    for word, tail in sorted(words.items()):
        by.setdefault(word[:1], {})[word[1:]] = tail
    parts = [re.escape(c) + alternatives(rest) if c else rest[""] for c, rest in by.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


@functools.cache
def key_pattern():
    """Matches a text in lower case, or one of its lines, that holds a key or, where a pair goes on in the next line, its part in this one."""
    begin, end = "(?<![a-z0-9])", "(?![a-z0-9])"
    words = {k: end for k in keys() if " " not in k}
    words |= {a: f"(?:[^a-z0-9]+{b}{end}|[^a-z0-9\\n]*(?:\\n|$))" for a, b in (k.split() for k in keys() if " " in k)}
    words["the"] = f"[^a-z0-9]+mit{end}"
    first = "".join(sorted({w[0] for w in words}))
    return f"(?=[{first}]){begin}{alternatives(words)}|(?:^|\\n)[^a-z0-9\\n]*mit{end}"


def forms(rng, filler, frames, copies):
    """Training texts from frames (of grants, of refusals): words and the families that they name."""
    grants, refusals = frames
    words = lambda t: re.findall(WORD_PATTERN, t.lower())
    some = lambda most: [rng.choice(filler) for _ in range(rng.randint(0, most))]
    rows, names = [], [(f, n) for f in sorted(NAMES) for n in NAMES[f]]
    for family, name in names:
        for _ in range(copies):
            rows += [([*some(4), *words(g.format(name)), *some(4)], {family}) for g in grants]
            rows += [([*some(4), *words(r.format(name)), *some(4)], set()) for r in refusals]
        if name not in PLAIN:
            rows += [(words(name), {family})] * copies
        rows += [([*some(3), *words(b.format(name)), *some(3)], set()) for b in BARE]
        rows += [([*some(3), *words(rng.choice(NEGATIONS)), *words(g.format(name)), *some(3)], set()) for g in grants if g.split()[0] in ("licensed", "released", "distributed", "available", "published", "governed", "covered")]
        for _ in range(6):
            other, second = rng.choice(names)
            both = words(rng.choice(grants).format(name)), words(rng.choice(grants).format(second))
            rows.append(([*some(4), *both[0], *some(8), *both[1], *some(4)], {family, other}))
            rows.append(([*words(rng.choice(grants).format(name)), rng.choice(("or", "and")), *words(second)], {family, other}))
            if other != family:
                rows.append(([*words(rng.choice(refusals).format(second)), *rng.choice(([], ["but"])), *both[0]], {family}))
    return rows


@functools.cache
def model(seed=3, copies=10, steps=160):
    """(vocabulary, weights, bias): logistic regressions, one a family, on templates, forms and noisy copies of them; nothing of the corpus.

    Forms held out whole, and a tenth of the noisy copies, set a temperature, so that probabilities are calibrated. Unknown is a class as the others:
    of texts that name no family.
    """
    rng = random.Random(seed)
    filler = sorted({w for t in OTHER for w in re.findall(WORD_PATTERN, t.lower())} - {"not", "no"})
    fit, test = forms(rng, filler, (GRANTS[:-5], REFUSALS[:-4]), 1), forms(rng, filler, (GRANTS[-5:], REFUSALS[-4:]), 1)
    whole = [(re.findall(WORD_PATTERN, t.lower()), {f} - {UNKNOWN}) for f in FAMILIES for t in (OTHER if f == UNKNOWN else TEMPLATES[f])]
    for words, own in whole:
        for c in range(copies):
            kept = [w for w in words if c == 0 or rng.random() > 0.06]
            for _ in range(0 if c == 0 else rng.randint(0, 6)):
                kept.insert(rng.choice((0, len(kept))), rng.choice(filler))
            (test if c == 1 else fit).append((kept, own))
    short = [(re.findall(WORD_PATTERN, g.format(n).lower()), {f}) for f in sorted(NAMES) for n in NAMES[f] for g in GRANTS[:-5]]
    for _ in range(900):
        (a, f), (b, g) = rng.choice(whole), rng.choice((*whole, *rng.sample(short, len(whole))))
        fit.append(([*a, *rng.sample(filler, rng.randint(0, 8)), *b], f | g))
    for _ in range(copies * 20):  # licence words alone, out of order
        kept = [*rng.sample(filler, 8), rng.choice(("license", "licensed", "copyright", "warranty", "permission", "reserved", "under license", "version"))]
        rng.shuffle(kept)
        fit.append((kept, set()))
    seen: dict = {}
    found = [{g for g in ngrams(" ".join(words)) if telling(g)} for words, _ in fit]
    for own in found:
        for g in own:
            seen[g] = seen.get(g, 0) + 1
    vocabulary = {g: i for i, g in enumerate(sorted({g for g, n in seen.items() if n >= 10}.union(*[t for _, t, _ in templates()])))}

    def matrix(rows):
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, (words, _) in enumerate(rows):
            own = [vocabulary[g] for g in ngrams(" ".join(words)) if g in vocabulary]
            x[i, own] = 1 / np.sqrt(max(len(own), 1))
        return x, np.array([[f in own for f in FAMILIES[:-1]] + [not own] for _, own in rows], np.float32)

    x, y = matrix(fit)
    w, b = np.zeros((len(vocabulary), len(FAMILIES)), np.float32), np.full(len(FAMILIES), -2, np.float32)
    v, u = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        d = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / len(x)
        v, u = 0.9 * v - 20 * (x.T @ d + 1e-6 * w), 0.9 * u - 2 * d.sum(axis=0)
        w, b = w + v, b + u
    x, y = matrix(test)
    z = np.where(y > 0, -1, 1) * (x @ w + b).astype(np.float64)
    heat = min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0), key=lambda t: np.logaddexp(0, z / t).mean())
    return vocabulary, np.round(w.astype(np.float64) / heat, 5), np.round(b.astype(np.float64) / heat, 5)


def judge(text):
    """(family, probability, cover, n-grams shared with the template) of each family that a window names, by plain Python; what scan() does."""
    vocabulary, w, b = model()
    own = {g for g in ngrams(text) if g in vocabulary}
    if not own:
        return []
    p = 1 / (1 + np.exp(-(b + sum(w[vocabulary[g]] for g in sorted(own)) / np.sqrt(len(own)))))
    if p[-1] >= LEAST_PROBABILITY or any(own == templates()[k][1] for k, _ in headings()):
        return []
    out, carrier = [], bool(own & templates()[-1][1])
    for k, family in enumerate(FAMILIES[:-1]):
        met = [(len(own & t), len(t)) for f, t, needs in templates() if f == family and len(own & t) >= LEAST_COVER * len(t) and (carrier or not needs)]
        if met and p[k] >= LEAST_PROBABILITY:
            out.append((family, float(p[k]), max(n / m for n, m in met), max(n for n, _ in met)))
    return out


def predict(text):
    """(family, probability, cover) of the likeliest family of one paragraph, or None."""
    return max(judge(text), key=lambda f: f[1])[:3] if judge(text) else None


def _weights(spark):
    """The model as a small table: n-gram, its weights, the templates that hold it. Its size is fixed by TEMPLATES."""
    vocabulary, w, _ = model()
    rows = [{"g": g, "w": w[i].tolist(), "t": [k for k, (_, t, _) in enumerate(templates()) if g in t]} for g, i in vocabulary.items()]
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<g:string,w:array<double>,t:array<int>>>")).alias("r")).select("r.*")


def grams(docs):
    """N-grams near a key word of the rows of docs(doc_id, text): rid (a number for each row), doc_id, and x of
    g (n-gram), a, b (lines of its first and last word, from 0), back, ahead (lines that may be joined before a and after b).

    Every row has one x without g, so none is lost.
    """
    word, key, blank = F.lit(f"({WORD_PATTERN})"), key_pattern(), "[a-z0-9]"
    low = F.lower("text")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.when(low.rlike(key), F.split(low, "\n")).otherwise(F.array().cast("array<string>")).alias("p"))
    rows = rows.select("*", F.transform("p", lambda x: x.rlike(key)).alias("keyed"), F.transform("p", lambda x: (F.length(x) <= WRAPPED) & x.rlike(blank)).alias("joins"))
    at = lambda flags, i: F.coalesce(F.get(flags, i), F.lit(False))

    def run(i, step):
        """How many lines from i on, up to LINES - 1, can be joined."""
        n = F.lit(LINES - 1)
        for d in range(LINES - 1, 0, -1):
            n = F.when(~at("joins", i + step * d), d - 1).otherwise(n)
        return n

    def line(x, i):
        own = at("joins", i)
        near = functools.reduce(lambda u, v: u | v, [at("keyed", i + d) for d in range(1 - LINES, LINES)])
        part = lambda w: F.struct(w.alias("w"), i.alias("i"))
        stop = F.array(part(F.lit("")))  # no n-gram reaches over it
        words = F.transform(F.regexp_extract_all(x, word, 1), part)
        return F.when(near & own, words).when(at("keyed", i), F.concat(stop, words, stop)).otherwise(stop)

    ends = F.transform("p", lambda x, i: F.struct(F.when(at("joins", i), run(i, -1)).otherwise(0).alias("back"), F.when(at("joins", i), run(i, 1)).otherwise(0).alias("ahead")))
    rows = rows.select("rid", "doc_id", F.flatten(F.transform("p", line)).alias("ws"), ends.alias("ends"))

    def every(n):
        words = lambda j: [F.get("ws", j + d) for d in range(n)]
        whole = F.transform(F.sequence(F.lit(0), F.size("ws") - n), lambda j: gram(words(j)))
        return F.when(F.size("ws") >= n, whole).otherwise(F.slice(none, 1, 0))

    def gram(words):
        a, b = words[0]["i"], words[-1]["i"]
        return F.struct(F.concat_ws(" ", *[w["w"] for w in words]).alias("g"), a.alias("a"), b.alias("b"), F.get("ends", a)["back"].alias("back"), F.get("ends", b)["ahead"].alias("ahead"))

    none = F.array(F.struct(F.lit(None).cast("string").alias("g"), *[F.lit(None).cast("int").alias(c) for c in ("a", "b", "back", "ahead")]))
    return rows.select("rid", "doc_id", F.explode(F.concat(none, *[every(n) for n in range(1, LONGEST + 1)])).alias("x"))


def _is(k):
    return lambda u: u == k


def scan(docs):
    """One row of every row of docs(doc_id, text): doc_id, n_licenses, families (distinct, sorted, comma-joined), spans (first line:family, in order;
    a paragraph that names several families gives one for each).

    A paragraph is a window of lines, see above. Null and empty texts, and texts without key words, have no licences: 0, '' and ''.
    Repeated rows are scanned each; an empty table stays empty; other columns are ignored. Only DataFrame functions run:
    n-grams of the few lines near a key word meet the weights, a broadcast of fixed size, and are summed by window.
    """
    spark = docs.sparkSession
    (_, _, b), last = model(), len(templates()) - 1
    met = grams(docs).select("rid", "doc_id", "x.*").join(F.broadcast(_weights(spark)), "g", "left").where("w IS NOT NULL OR g IS NULL").repartition("rid", "doc_id")
    # one exchange for all groupings below, of n-grams met and not of their windows
    met = met.withColumn("s", F.explode_outer(F.when(F.col("b") - LINES + 1 <= F.col("a"), F.sequence(F.greatest(F.col("a") - F.col("back"), F.col("b") - LINES + 1), F.col("a")))))
    met = met.withColumn("e", F.explode_outer(F.sequence("b", F.least(F.col("b") + F.col("ahead"), F.col("s") + LINES - 1))))
    met = met.groupBy("rid", "doc_id", "s", "e", "g").agg(F.first("w").alias("w"), F.first("t").alias("t"))  # an n-gram counts once
    sums = met.groupBy("rid", "doc_id", "s", "e").agg(F.count("w").alias("n"), *[F.sum(F.col("w")[k]).alias(f"w{k}") for k in range(len(FAMILIES))], F.flatten(F.collect_list("t")).alias("t"))
    # every row keeps its place, so the number rid is made once and never joined on
    chance = lambda k: 1 / (1 + F.exp(-(F.col(f"w{k}") / F.sqrt("n") + F.lit(float(b[k])))))
    likely = F.array(*[chance(k) >= LEAST_PROBABILITY for k in range(len(FAMILIES) - 1)])
    largest = max(n for _, n in headings())
    heading = functools.reduce(lambda u, v: u | v, [(F.col("n") == n) & (F.size(F.filter("t", _is(k))) == n) for k, n in headings()])
    named = (F.col("n") > 0) & (chance(len(FAMILIES) - 1) < LEAST_PROBABILITY) & ((F.col("n") > largest) | ~heading)
    sums = sums.withColumn("likely", F.when(named, likely))
    least = F.array(*[F.lit(LEAST_COVER * len(t)) for _, t, _ in templates()])
    owner = F.array(*[F.lit(FAMILIES.index(f) if f else -1) for f, _, _ in templates()])
    needs = F.array(*[F.lit(c) for _, _, c in templates()])
    name = F.array(*[F.lit(f or "") for f, _, _ in templates()])
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  a lambda's argument is worked out once
    fits = lambda u, t: (u["shared"] >= F.get(least, u["t"])) & (~F.get(needs, u["t"]) | F.array_contains(t, last))
    mine = once(F.col("likely"), lambda p: F.filter("t", lambda t: F.coalesce(F.get(p, F.get(owner, t)), F.lit(False))))
    count = once(mine, lambda own: F.transform(F.array_distinct(own), lambda t: F.struct(F.size(F.filter(own, lambda u: u == t)).alias("shared"), t.alias("t"))))
    families = lambda met: F.array_sort(F.array_distinct(F.transform(met, lambda u: F.get(name, u["t"]))))
    whole = lambda met: F.struct((-F.array_max(met)["shared"]).alias("most"), (F.col("e") - F.col("s")).alias("more"), F.col("s").alias("s"), F.col("e").alias("e"), families(met).alias("families"))
    named = once(F.filter(count, lambda u: fits(u, F.col("t"))), lambda met: F.when(F.size(met) > 0, whole(met)))
    sums = sums.select("rid", "doc_id", named.alias("named"))
    found = sums.groupBy("rid", "doc_id").agg(F.array_sort(F.collect_list("named")).alias("all"))
    empty = F.slice(F.col("all"), 1, 0)
    apart = F.aggregate("all", empty, lambda kept, v: F.when(F.exists(kept, lambda u: (u["s"] <= v["e"]) & (v["s"] <= u["e"])), kept).otherwise(F.concat(kept, F.array(v))))
    each = F.flatten(F.transform(apart, lambda v: F.transform(v["families"], lambda f: F.struct(v["s"].alias("line"), f.alias("family")))))
    found = found.select("doc_id", F.array_sort(each).alias("s"))
    families = F.array_join(F.array_sort(F.array_distinct(F.col("s")["family"])), ",")
    spans = F.array_join(F.transform("s", lambda v: F.concat_ws(":", v["line"], v["family"])), ",")
    return found.select("doc_id", F.size("s").cast("long").alias("n_licenses"), families.alias("families"), spans.alias("spans"))


def op8_licenses(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def digest(text):
    """n_licenses, families, spans of a text by plain Python, for tests."""
    lines = (text or "").lower().split("\n")
    joins = [len(p) <= WRAPPED and bool(re.search("[a-z0-9]", p)) for p in lines]
    found = []
    for s in range(len(lines)):
        for e in range(s, min(s + LINES, len(lines))):
            if e > s and not all(joins[s : e + 1]):
                break
            if named := judge(" ".join(lines[s : e + 1])):
                found.append((-max(f[3] for f in named), e - s, s, e, sorted(f[0] for f in named)))
    kept: list = []
    for v in sorted(found):
        if all(u[3] < v[2] or v[3] < u[2] for u in kept):
            kept.append(v)
    spans = sorted((v[2], f) for v in kept for f in v[4])
    return len(spans), ",".join(sorted({f for _, f in spans})), ",".join(f"{i}:{f}" for i, f in spans)
