"""Licence scans by a trained paragraph classifier (DataFrame operations only on the data).

Paragraphs are lines; a line of `WRAPPED` characters or more that doesn't end a sentence goes
on in the next one, as notices wrapped at a column do. Sparse logistic regression over word n-grams (one to three words)
tells licence families and the class `unknown` apart; its weights are fitted here, on the
driver, from the templates below and disguised forms of them (words left out, put in, or
put around), with ordinary sentences as unknown. L1 shrinkage keeps few n-grams, and a
temperature fitted on forms that were held out calibrates the probabilities. A paragraph
of a predicted family is confirmed by comparison with that family's templates: the share
of a template's word pairs that it contains.

Scoring is one projection: no shuffle, no explode, whole texts. A paragraph without any
word of the kept n-grams' anchors has only the intercepts, which mean unknown.

Defined cases: a null or empty text has no licence; a text may have any number of licence
paragraphs, all reported; repeated rows are scanned alike; an empty table gives an empty
result; columns other than id and text are not read.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table

PROBABILITY = 0.5
CONTAINED = 0.5
UNKNOWN = "unknown"
WRAPPED = 40

#: Notices of licence families.
TEMPLATES = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Distributed under the Apache 2.0 license.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution License",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC-SA 4.0 for non-commercial use.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "Released into the public domain under CC0.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}

#: Sentences that name licences and are none.
OTHERS = """
His driving license was renewed under the new rules.
The license plate of the car could not be read.
All work was released to the public last week.
The committee licensed the restaurant to sell wine.
The public library is free for any person.
She was given permission to use the software of the school.
A copy of the letter was found in the file.
The general public was not admitted to the hearing.
The version of the story that was published is free of errors.
The software foundation held its meeting in the spring.
Apache helicopters were seen over the valley.
The students at MIT released a new robot.
Mozilla announced a version of its browser.
The terms of the contract are subject to change.
Creative work is common in this attribution of the painting.
The gnu is an animal of the general plains.
Commercial use of the road is not permitted without notice.
The license fee for public television was raised.
The film is released under another title abroad.
It was redistributed among the poor with or without their consent.
The copyright of this book lies with the author.
All rights reserved.
The new version 2.0 is out now, as is version 3.
""".strip().splitlines()

#: Words too common to anchor an n-gram.
STOP = set("a an and any are as at be by can file for found from in is it may new not of on or other out published that the this to use used was will with without work you your all copy should have received along program".split())

_WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
FILLER = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system question government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend".split()


def words_of(line: str) -> list[str]:
    return re.findall(_WORD, line.lower())


def grams_of(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def _forms(words: list[str], rng, n: int) -> list[list[str]]:
    """The words, and n forms with some left out, put in or put around."""
    out = [words]
    for _ in range(n):
        w = [x for x in words if rng.random() > 0.08]
        if rng.random() < 0.5:
            w = list(rng.choice(FILLER, rng.integers(0, 8))) + w + list(rng.choice(FILLER, rng.integers(0, 8)))
        elif w:
            w.insert(int(rng.integers(len(w))), str(rng.choice(FILLER)))
        out.append([str(x) for x in w])
    return out


def train(templates: dict = TEMPLATES, others: list[str] = OTHERS, forms: int = 14, seed: int = 5) -> dict:
    """Softmax regression with an L1 penalty by proximal gradient steps, and its temperature."""
    rng = np.random.default_rng(seed)
    families = [UNKNOWN, *sorted(templates)]
    rows = [(words_of(o), 0) for o in others]
    rows += [(w, families.index(f)) for f in templates for t in templates[f] for w in [words_of(t)]]
    data = [(form, y) for w, y in rows for form in _forms(w, rng, forms)]
    generic = sorted({w for w, y in rows if y for w in w} | set(FILLER))
    # Loose words of notices in any order are unknown, so are short pieces of plain words.
    data += [([str(x) for x in rng.choice(generic, rng.integers(1, 12))], 0) for _ in range(600)]
    mark = rng.random(len(data)) < 0.2
    fit, held = [d for d, m in zip(data, mark) if not m], [d for d, m in zip(data, mark) if m]
    known = {w for w, y in rows if y for w in w} - STOP
    vocab: dict = {}
    for w, y in rows:
        if y:
            for g in grams_of(w):
                if set(g.split()) & known:
                    vocab.setdefault(g, len(vocab))

    def matrix(part):
        x = np.zeros((len(part), len(vocab)))
        for row, (w, _) in zip(x, part):
            row[[vocab[g] for g in set(grams_of(w)) if g in vocab]] = 1
        return x, np.array([y for _, y in part])

    x, y = matrix(fit)
    target = np.eye(len(families))[y]
    weight = np.sqrt(len(y) / np.bincount(y, minlength=len(families)))[y][:, None]
    weight /= weight.mean()
    w, b = np.zeros((x.shape[1], len(families))), np.zeros(len(families))
    step = 8.0 / max(1.0, np.linalg.norm(x, 2) ** 2 / len(x))
    for _ in range(300):
        g = weight * (_softmax(x @ w + b) - target) / len(x)
        w -= step * (x.T @ g)
        b -= step * g.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - step * 2e-5, 0)
    kept = np.flatnonzero(np.abs(w).max(1) > 0)
    xh, yh = matrix(held)
    losses = {t: -np.log(_softmax((xh @ w + b) / t)[np.arange(len(yh)), yh] + 1e-12).mean() for t in np.arange(0.4, 3.05, 0.1)}
    t = min(losses, key=losses.get)
    names = list(vocab)
    weights = {names[k]: [round(float(v), 6) for v in w[k] / t] for k in kept}
    anchors = sorted({a for g in weights for a in g.split() if a in known})
    pairs = {f: [sorted({" ".join(p) for p in zip(ws, ws[1:])}) for ws in map(words_of, ts)] for f, ts in templates.items()}
    return {"families": families, "bias": [round(float(v), 6) for v in b / t], "weights": weights, "anchors": anchors, "pairs": pairs}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _constant(value, kind: str) -> Column:
    """A typed literal: the optimizer folds it once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _grams(words: Column, k: int) -> Column:
    """Runs of k words."""
    n = F.size(words) - (k - 1)
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(k))))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<string>"))


def _paragraphs(text: Column) -> Column:
    """Lines, those joined that a wrap has parted."""
    return F.split(F.regexp_replace(text, rf"\n(?<=[^\n]{{{WRAPPED - 1}}}[^.!?:;\s][ \t\r]{{0,3}}\n)(?=[ \t]*\S)", " "), "\n")


def found_licenses(text: Column, model: dict) -> Column:
    """array<struct<paragraph, family, probability, contained>> of the licence paragraphs of a text."""
    k = len(model["families"])
    anchors = _constant(model["anchors"], "array<string>")
    vocab = _constant(sorted(model["weights"]), "array<string>")
    weights = _constant(model["weights"], "map<string,array<double>>")
    bias = _constant(model["bias"], "array<double>")
    families = _constant(model["families"], "array<string>")
    pairs = _constant(model["pairs"], "map<string,array<array<string>>>")
    lines = _paragraphs(F.coalesce(text, F.lit("")))
    found = F.transform(lines, lambda p, i: F.struct(i.alias("i"), F.regexp_extract_all(F.lower(p), F.lit(f"({_WORD})"), 1).alias("w")))
    found = F.filter(found, lambda x: F.arrays_overlap(x["w"], anchors))
    found = F.transform(found, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w"), F.array_intersect(F.concat(x["w"], _grams(x["w"], 2), _grams(x["w"], 3)), vocab).alias("g")))
    add = lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, b: a + b)
    found = F.transform(found, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w"), F.aggregate(F.array_sort(x["g"]), bias, add).alias("z")))
    found = F.transform(found, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w"), F.array_max(x["z"]).alias("m"), x["z"].alias("z")))
    total = lambda x: F.aggregate(x["z"], F.lit(0.0), lambda a, v: a + F.exp(v - x["m"]))
    found = F.transform(found, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w"), F.get(families, F.array_position(x["z"], x["m"]).cast("int") - 1).alias("f"), (1 / total(x)).alias("p")))
    found = F.filter(found, lambda x: (x["f"] != UNKNOWN) & (x["p"] >= PROBABILITY))

    def contained(x):
        own = F.array_distinct(_grams(x["w"], 2))
        return F.array_max(F.transform(F.element_at(pairs, x["f"]), lambda t: F.size(F.array_intersect(t, own)) / F.size(t)))

    found = F.transform(found, lambda x: F.struct(x["i"].alias("paragraph"), x["f"].alias("family"), F.round(x["p"], 6).alias("probability"), contained(x).alias("contained")))
    assert k == len(model["bias"])
    return F.filter(found, lambda x: x["contained"] >= CONTAINED)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_licenses, family (of the surest paragraph), families, licenses."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.size(_paragraphs(F.col(text_col))).alias("k"), found_licenses(F.col(text_col), model or train()).alias("licenses"))
    best = F.array_max(F.transform("licenses", lambda x: F.struct(x["probability"].alias("p"), (-x["paragraph"]).alias("i"), x["family"].alias("f"))))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"]))), ",")
    return found.select("doc_id", F.greatest(F.coalesce("k", F.lit(0)), F.lit(0)).cast("long").alias("n_paragraphs"), F.size("licenses").cast("long").alias("n_licenses"), best["f"].alias("family"), families.alias("families"), "licenses")


def op8_licenses(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).drop("licenses")


QUERIES = {"op8_licenses": op8_licenses}
ORACLES = {}
