"""Operator 2: licence scan by a trained paragraph classifier.

A paragraph ends at an empty line or at a line that ends a sentence; other lines go on in the next,
so that a notice wrapped over lines is one paragraph. A softmax regression over the n-grams of one
to three words that a paragraph has gives the probability of each licence family, of "unknown" (a
notice of no family that is known) and of "none" (other prose). Its weights are sparse by an L1
penalty: n-grams that tell nothing have none, and a paragraph without a weighted n-gram is none by
the intercepts alone. Paragraphs that are not more likely none than anything else are candidates;
a family is reported where its probability reaches CERTAIN and COVER of the n-grams of one of its
templates (names, identifiers, sentences of the licences) are there; other candidates are unknown. A name of one
word confirms nothing by itself: its templates are the word with what a notice has beside it.

Training takes place on the driver, in numpy. Phrases, unknown names and prose are split three
ways: the weights are trained on the first part, the temperature of the probabilities is fitted on
the second, and accuracy and calibration error are measured on the third, over all and for each class. Its
phrases, unknown names and prose neither has seen; names and texts of licences are the same, as only those that
are known can be told: train(blind=True) measures what becomes of others. The number of labelled rows is TRAIN_COPIES times the texts below. licence_weights.json holds
what train() gave; the weights that are broadcast depend on these texts alone, not on the corpus. Scoring is DataFrame operations only, with
weights in whole ten-thousandths, so that sums are exact in any order.

Defined cases: a null text has no paragraphs; rows alike in id and text count once and come out
alike; an n-gram counts once in a paragraph, however often it is there; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, small_table
from .decontaminate import ascii_lower

TRAIN_COPIES = 4
CERTAIN = 0.6
COVER = 0.6
UNKNOWN, NONE = "unknown", "none"
SCALE = 10_000

#: Names and identifiers of each family (fixed values).
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPL", "AGPL-3.0", "AGPLv3"],
    "apache": ["Apache License", "Apache License, Version 2.0", "Apache-2.0", "Apache 2.0 license"],
    "bsd": ["BSD License", "BSD-style license", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD license"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"],
    "cc-by-nc-nd": ["CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Creative Commons Attribution-NonCommercial-NoDerivs License"],
    "cc-by-nc-sa": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike License"],
    "cc-by-nd": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivs License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "cc0": ["CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "CC0"],
    "epl": ["Eclipse Public License", "Eclipse Public License - v 2.0", "EPL-2.0", "EPL 2.0"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU GPL", "GPL", "GPL-3.0-or-later", "GPLv2"],
    "isc": ["ISC License", "ISC license terms"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL", "LGPL-2.1", "GNU LGPL"],
    "mit": ["MIT License", "MIT license terms", "MIT terms", "Expat License", "MIT/X11 license", "MIT-Lizenz", "licence MIT", "licencia MIT"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "MPL-2.0", "MPL 2.0"],
    "unlicense": ["Unlicense", "The Unlicense"],
}
#: Paragraphs of the licences and of the notices that they ask for (fixed values).
PARAGRAPHS = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "In no event and under no legal theory, whether in tort (including negligence), contract, or otherwise, unless required by applicable law or agreed to in writing, shall any Contributor be liable to You for damages",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal", "Dedicated to the public domain under CC0 1.0"],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. See the GNU General Public License for more details.",
    ],
    "epl": ["THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE. ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "mpl": ["Under no circumstances and under no legal theory, whether tort (including negligence), contract, or otherwise, shall any Contributor be liable to You for any direct, indirect, special, incidental, or consequential damages", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
#: Notices that name a licence, in three parts: for weights, temperature and measures (fixed values).
PHRASES = (
    ["{}", "Released under the {}", "Licensed under the {}", "Licensed under {}", "This work is licensed under the {}", "Distributed under the terms of the {}", "SPDX-License-Identifier: {}", "This file is covered by the {}", "The license is {}", "made available under {}", "See {} for the terms", "Use of this source code is governed by a {}", "Lizenziert unter der {}", "Sous {}", "Bajo la {}"],
    ["This program is released under the terms of the {}", "License: {}", "Published under {}", "The code may be used under the {}", "You may copy it under the {}", "Veröffentlicht unter der {}"],
    ["The project is available under the {}", "This software is provided under the {}", "Copyright the authors, under the {}", "It comes with the {}", "Please see the {}", "Everything here is subject to the {}", "Das Programm steht unter der {}"],
)
#: Licences of no known family, in the same three parts (fixed values).
HOUSE = (
    ["private agreement", "house license", "terms of the contract", "Moonlight License, version 2", "commercial license", "license of the company", "Ordinance of the harbour", "proprietary license", "End User License Agreement", "license of the museum", "Garden License 1.0", "contract with the publisher", "Do What You Want To Public License", "Harbour Public License", "Stone Public License, version 1.1", "Ocean Community License", "shareware license", "evaluation license", "Freeware license agreement", "terms of service of the company", "Lake License v2", "permission of the owner", "Vineyard Artistic License", "research license"],
    ["Sunrise License, version 3", "agreement with the owner", "license of the library", "Academic Free Use Agreement", "Forest Public License, version 2", "trial license"],
    ["River License, version 4", "site license", "internal terms of use", "license of the university", "Mountain Public License 1.2", "volunteer license agreement"],
)
#: Notices that name no licence, in the same three parts (fixed values).
RIGHTS = (
    ["All rights reserved", "Copyright by the authors", "Copyright 2019 the authors. All rights reserved", "No part of this work may be copied without permission of the publisher", "Unauthorized copying of this file is prohibited", "Confidential and proprietary", "May not be redistributed without written permission"],
    ["Copyright 2021. All rights are reserved by the owner", "Copying is prohibited without permission of the owner"],
    ["Copyright the publisher, all rights reserved worldwide", "This file may not be copied without written permission of the owner"],
)
#: Prose, some of it with words that licences have, in the same three parts (fixed values).
PROSE = (
    ["A driving licence is needed to rent a car", "The general public was not admitted", "The license of the radio station was renewed", "They released the album under another name", "Permission is needed to enter", "Permission was granted to the club", "It was published in the public domain of the city", "The warranty covers two years", "A copy of this letter was sent to the office", "Redistribution of income is a matter of politics", "The copyright office opens at nine", "She studied at MIT before the war", "The Apache people live in the west", "Mozilla and others agreed", "The commons were open to all", "Creative people met in the commons", "The fishing license costs more this year", "The source code form was sent by mail", "The terms of the school end in June", "He was free to copy the work of the others", "The use of this road is not permitted in winter", "In the following the conditions of the experiment are given", "This is the list of the names of the holders", "Any person may use the software of the library for free", "The distribution of the goods was delayed", "You can see the details in the file on the table", "All of it was provided by the city, with some limits", "The version that was published in the other paper is longer"],
    ["The license of the pilot was taken away", "They met at the general store", "The public was free to use the garden", "The work was released last year to the public", "Terms were agreed with the workers"],
    ["The licence to fish was given by the village", "A copy of the software was sent to the school", "The rights of the people were discussed", "The author was free to publish the book", "The house was sold under the terms of the will"],
)
#: Sentences that speak of a licence, or of what else its name stands for, and grant nothing, in the same three parts (fixed values).
MENTIONS = (
    ["The {} was written by him", "He compared the {} with the other one", "The {} project was begun long ago", "She wrote a book on the {}", "Some think that the {} is too long", "The history of the {}", "They spoke of the {} at the conference", "Why the {} was chosen by few", "It was written for the {} by a friend", "A talk about the {} was held", "Many people had read about the {}", "The {} has been discussed in the press", "Nobody knew what the {} was", "They sell badges with the name {}", "Her paper on the {} was praised", "The authors of the {} met again", "He had never heard of the {}", "The {} is often compared with others", "What is the {} and who wrote it", "There was a debate about the {} for many years", "The {} and its history"],
    ["An essay about the {}", "The {} is older than that", "Lawyers argued about the {}"],
    ["The author of the {} gave a talk", "He wears a badge with {} on it", "Nobody there had heard of the {}", "The {} was discussed for years"],
)
OTHERS = [x for part in (*RIGHTS, *PROSE) for x in part] + [p.format(n) for n in HOUSE[0] for p in PHRASES[0][1:3]]

FAMILIES = [*NAMES, UNKNOWN, NONE]
_SENTENCE = re.compile(r"(?<=[.:;])\s+(?=[A-Z])")
_TOKEN = re.compile(r"[a-z0-9]+")
#: Where paragraphs end, in the syntax that both Java and Python read.
BREAK = r"""\n(?:(?<=[.!?:;]\n)|(?<=[.!?:;]["')\]\x20\r]\n)|[\x20\t\r\x0B\f]*\n)"""


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def runs(words: list[str], n: int) -> set[str]:
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def grams(words: list[str]) -> set[str]:
    return runs(words, 1) | runs(words, 2) | runs(words, 3)


def template_grams(words: list[str]) -> set[str]:
    """What a template is compared by: its runs of three words, or the whole of a shorter one."""
    return runs(words, min(3, len(words)))


#: What must stand beside a name of one word, as such a word alone says nothing of what is granted (fixed values).
CUES = ("under the {}", "under {}", "license {}", "licence {}", "identifier {}", "{} license", "{} licensed", "terms of the {}", "terms of {}", "unter der {}", "licensed {}", "license is {}", "license is the {}", "subject to the {}", "by the {}", "by a {}", "with the {}")


def _templates() -> list[tuple[str, str]]:
    out = []
    for family, names in NAMES.items():
        out += [(family, n) for n in names if len(tokens(n)) > 1]
        out += [(family, c.format(n)) for n in names if len(tokens(n)) == 1 for c in CUES]
        for text in PARAGRAPHS.get(family, ()):
            out.append((family, text))
            parts = _SENTENCE.split(text)
            out += [(family, s) for s in parts if len(parts) > 1 and len(tokens(s)) >= 6]
    return out


#: What predictions are compared with: (family, text).
VARIANTS = _templates()


def gram_hash(gram: str) -> int:
    """What xxhash64 of the words, one column each, is in Spark."""
    h = 42
    for w in gram.split():
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


def notices(part: int, copies: int, seed: int, keep=lambda text: True) -> list[tuple[list[str], int]]:
    """Labelled paragraphs, as words, of one of the three parts: as they are, and with words lost
    and others about them. keep says which names and texts of licences are used."""
    rng = np.random.Generator(np.random.PCG64(seed))
    filler = sorted({w for t in PROSE[part] for w in tokens(t)})
    own: list[tuple[str, int]] = []
    for k, family in enumerate(FAMILIES):
        own += [(p.format(n), k) for n in NAMES.get(family, ()) if keep(n) for p in PHRASES[part]]
        own += [(t, k) for f, t in VARIANTS if f == family and len(tokens(t)) > 4 and t not in NAMES[family] and keep(t)] * 2
    unknown, none = len(FAMILIES) - 2, len(FAMILIES) - 1
    own += [(p.format(n), unknown) for n in HOUSE[part] for p in PHRASES[part] if p != "{}"] + [(t, unknown) for t in RIGHTS[part] * 3]
    own += [(t, none) for t in PROSE[part] * 4]
    names = [n for k, n in enumerate(n for x in NAMES.values() for n in x) if k % 3 == part % 3] + ["GPL", "BSD", "Apache", "MIT", "Mozilla", "GNU", "Eclipse", "Creative Commons"]
    own += [(m.format(n), none) for n in names for m in MENTIONS[part]]
    out = []
    for text, k in own:
        for n in range(copies):
            words = tokens(text)
            if n:
                if len(words) > 8 and n % 2:  # a part of it
                    at = int(rng.integers(0, len(words) - 6))
                    words = words[at : at + int(rng.integers(7, len(words) + 1))]
                elif len(words) > 8:
                    words = [w for w in words if rng.random() > 0.08]
                before, after = rng.integers(0, 8, 2)
                words = [*rng.choice(filler, before).tolist(), *words, *rng.choice(filler, after).tolist()]
            out.append((words, k))
    for _ in range(copies * 60):  # prose words in any order
        out.append((rng.choice(filler, int(rng.integers(3, 60))).tolist(), none))
    return out


def _calibration_error(p: np.ndarray, label: np.ndarray, bins: int = 10) -> float:
    """How far, on average, the probability of the likeliest class is from how often it is right."""
    best, right = p.max(axis=1), p.argmax(axis=1) == label
    at = np.minimum((best * bins).astype(int), bins - 1)
    return float(sum(abs(best[at == k].sum() - right[at == k].sum()) for k in range(bins)) / len(label))


def _in_part(part: int, parts: int = 3):
    """Whether a licence's name or text is dealt to a part, by its hash."""
    return lambda text: xxhash.xxh64_intdigest(text.encode(), seed=5) % parts == part


def train(copies: int = TRAIN_COPIES, rounds: int = 250, penalty: float = 2e-4, blind: bool = False) -> dict:
    """{"bias", "weights": gram -> list} in whole numbers of 1 / SCALE, and the figures of measured().

    Held-out paragraphs have phrases, unknown names and prose that training has not seen. Names and texts of licences
    must be known to be told; with blind=True a third of those, too, is kept from training, and held-out paragraphs have that
    third alone.

    Accelerated proximal steps on the mean log loss with an L1 penalty on the weights."""
    unseen = _in_part(0)
    own = notices(0, copies, 1, (lambda t: not unseen(t)) if blind else (lambda t: True))
    sets = [grams(w) for w, _ in own]
    count: dict[str, int] = {}
    for s in sets:
        for g in s:
            count[g] = count.get(g, 0) + 1
    place = {g: k for k, g in enumerate(sorted(g for g, n in count.items() if n > 2))}

    def matrix(found: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(found), len(place) + 1), dtype=np.float32)
        x[:, -1] = 1  # the intercepts
        for i, s in enumerate(found):
            x[i, [place[g] for g in s if g in place]] = 1
        return x

    x, goal = matrix(sets), np.eye(len(FAMILIES), dtype=np.float32)[[k for _, k in own]]
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = x.T @ (x @ (v / np.linalg.norm(v)))
    step = 2 * len(x) / float(np.linalg.norm(v))
    w = np.zeros((x.shape[1], len(FAMILIES)), dtype=np.float32)
    ahead, t = w, 1.0
    for _ in range(rounds):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        new = ahead - step * (x.T @ ((p / p.sum(axis=1, keepdims=True) - goal) / len(x)))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + np.float32((t - 1) / after) * (new - w), new, after

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    held = notices(1, copies, 2)
    z, label = matrix([grams(words) for words, _ in held]) @ w, np.array([k for _, k in held])
    scale = min(np.linspace(0.3, 4.0, 75), key=lambda s: -np.log(softmax(z * s)[np.arange(len(z)), label] + 1e-12).mean())
    whole = np.rint(w * scale * SCALE).astype(int)
    model = {"bias": whole[-1].tolist(), "weights": {g: whole[k].tolist() for g, k in place.items() if whole[k].any()}}
    return model | measured(model, copies, unseen if blind else (lambda t: True))


def measured(model: dict, copies: int = TRAIN_COPIES, keep=lambda text: True) -> dict:
    """Figures of a model over the third part. by_class: n, the share of a class's paragraphs that are told (found), of
    what is told as the class the share that is (right), and how far their mean probability is from that (gap)."""
    held = notices(2, copies, 3, keep)
    z = np.array([np.sum([model["bias"], *(model["weights"][g] for g in grams(words) if g in model["weights"])], axis=0) for words, _ in held]) / SCALE
    e = np.exp(z - z.max(axis=1, keepdims=True))
    p, label = e / e.sum(axis=1, keepdims=True), np.array([k for _, k in held])
    best, told = p.max(axis=1), p.argmax(axis=1)
    by_class = {}
    for k, f in enumerate(FAMILIES):
        own, said = label == k, told == k
        if own.any() and said.any():
            right = float(own[said].mean())
            by_class[f] = {"n": int(own.sum()), "found": round(float(said[own].mean()), 3), "right": round(right, 3), "gap": round(abs(float(best[said].mean()) - right), 3)}
    return {"held_out_accuracy": float((told == label).mean()), "calibration_error": _calibration_error(p, label), "by_class": by_class}


@lru_cache(maxsize=1)
def load_model() -> dict:
    """The model in licence_weights.json: what train() gave, with the weights that are not 0."""
    held = json.loads(Path(__file__).with_name("licence_weights.json").read_text())
    weights = {}
    for g, some in held["weights"].items():
        weights[g] = [0] * len(FAMILIES)
        for family, w in some.items():
            weights[g][FAMILIES.index(family)] = w
    return held | {"bias": [held["bias"][f] for f in FAMILIES], "weights": weights}


def save_model(model: dict) -> None:
    some = {g: {f: x for f, x in zip(FAMILIES, w, strict=True) if x} for g, w in sorted(model["weights"].items())}
    held = model | {"bias": dict(zip(FAMILIES, model["bias"], strict=True)), "weights": some}
    Path(__file__).with_name("licence_weights.json").write_text(json.dumps(held, indent=0) + "\n")


def _index(model: dict) -> list[dict]:
    """hash, w (a weight for each class), v (templates that are compared by the n-gram)."""
    have = [template_grams(tokens(t)) for _, t in VARIANTS]
    zero = [0] * len(FAMILIES)
    every = sorted(set(model["weights"]).union(*have))
    return [{"gram": g, "hash": gram_hash(g), "w": model["weights"].get(g, zero), "v": [k for k, s in enumerate(have) if g in s]} for g in every]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each candidate: id, th (hash of the text), paragraph (its number, from 0), probability
    (of the likeliest class), family (or "unknown"), cover (share of the nearest template found)."""
    model = load_model()
    index = _index(model)
    first = sorted({r["gram"].split()[0] for r in index})
    known = [r["hash"] for r in index]
    none = F.array().cast("array<bigint>")

    def told(paragraph: Column) -> Column:
        """Hashes of the paragraph's n-grams that the index has; a run past its end is one of fewer words."""
        def of(t: Column) -> Column:
            every = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(t, i).isin(first))
            each = F.transform(every, lambda i: F.array(*[F.xxhash64(*[F.get(t, i + j) for j in range(n)]) for n in (1, 2, 3)]))
            return F.when(F.size(t) > 0, F.array_distinct(F.filter(F.flatten(each), lambda h: h.isin(known)))).otherwise(none)

        return let(F.regexp_extract_all(paragraph, F.lit("[a-z0-9]+"), F.lit(0)), of)

    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    found = F.filter(F.transform(F.split(text, BREAK, -1), lambda x, i: F.struct(i.alias("i"), told(x).alias("g"))), lambda p: F.size(p["g"]) > 0)
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.explode_outer(found).alias("p")).filter("p is not null")
    rows = rows.select("id", "th", F.col("p.i").alias("paragraph"), F.explode("p.g").alias("hash")).distinct()  # rows alike count once
    table = small_table(df.sparkSession, index, "hash bigint, w array<bigint>, v array<int>")
    met = rows.join(F.broadcast(table), "hash")
    sums = [(F.sum(F.get("w", F.lit(k))) + F.lit(model["bias"][k])).alias(f"z{k}") for k in range(len(FAMILIES))]
    per = met.groupBy("id", "th", "paragraph").agg(*sums, F.flatten(F.collect_list("v")).alias("v"))
    z = F.array(*[F.col(f"z{k}") / SCALE for k in range(len(FAMILIES))])
    per = per.select("id", "th", "paragraph", "v", let(z, lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a)))).alias("e"))
    best = F.array_max(F.transform("e", lambda x, i: F.struct(x.alias("e"), (-i).alias("k"))))
    per = per.withColumn("best", best).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    per = per.filter(F.col("best.k") != 1 - len(FAMILIES))
    per = per.withColumn("probability", F.col("best.e") / F.col("total")).withColumn("name", F.get(F.array(*map(F.lit, FAMILIES)), -F.col("best.k")))
    sizes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("f"), F.lit(len(template_grams(tokens(t)))).alias("n")) for k, (f, t) in enumerate(VARIANTS)])
    share = lambda v: F.size(F.filter("v", lambda x: x == v["k"])) / v["n"]
    cover = F.coalesce(F.array_max(F.transform(F.filter(sizes, lambda v: v["f"] == F.col("name")), share)), F.lit(0.0))
    per = per.withColumn("cover", cover)
    sure = (F.col("probability") >= CERTAIN) & (F.col("cover") >= COVER)
    return per.select("id", "th", "paragraph", "probability", F.when(sure, F.col("name")).otherwise(UNKNOWN).alias("family"), "cover")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_candidates, n_licences, n_unknown, families (comma-joined)."""
    known: Column = F.col("family") != UNKNOWN
    per = scan(df, id_col, text_col).groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(known).alias("n_licences"), F.count_if(~known).alias("n_unknown"), F.array_join(F.array_sort(F.collect_set(F.when(known, F.col("family")))), ",").alias("families")
    )
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"))
    met = docs.join(per, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    return met.select(F.col("id").alias(id_col), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_candidates", "n_licences", "n_unknown")], F.coalesce("families", F.lit("")).alias("families"))
