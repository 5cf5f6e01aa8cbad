"""Licence scan: a trained paragraph classifier whose predictions templates must confirm.

Method. A paragraph is a run of lines that are not blank: notices are wrapped as they come. Its words and word pairs,
lower-cased and without marks, are hashed; a multinomial logistic regression, learnt by FTRL, scores the licence
families and an unknown class over windows of the paragraph as long as the templates are, and half as long again, so that a notice inside a long paragraph is not diluted; a temperature fitted on examples apart
calibrates it. Learnt are variations of the templates below (words dropped, fillers and years put in) against
lines of the corpus (the `sample_lines` distinct ones that come first by a hash: the bound of the fit)
and stray legal phrases. A family predicted with at least `min_score` stands if a template of it is found in the
window: the share of the template's word pairs that it has is at least `min_similarity`. Of confirmed windows
that overlap the most similar stands; every other one is reported, so a paragraph can have several families.

Scale. One pass over the documents in batches, no shuffle; model and templates have a fixed size. Only
paragraphs that have the asked share of some template's word pairs are classified: the others cannot be confirmed.

Edge cases: null or empty text has no paragraph and gives no row; texts and paragraphs of any length are read
whole; repeated notices of a document each give a row, as do repeated documents and rows with a null id; of equally similar windows the shortest, then the likeliest, then
the first stands; an empty corpus trains against the stray phrases alone; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import common
from docweave.llm.ftrl import Ftrl, temperature

HASH_BITS = 16
SIZE = 1 << HASH_BITS
BIAS = SIZE
SCALE = 10.0

#: Notices as the licences' own texts and usual practice word them.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v2",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "BSD": (
        "Licensed under the BSD 3-Clause License",
        "Released under the 2-clause BSD license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "ISC": ("Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0": ("Dedicated to the public domain under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "Proprietary": ("All rights reserved. No part of this publication may be reproduced without prior written permission", "Copyright 2020 Example Inc. All rights reserved."),
}
STRAY = (
    "The driver must show a license at the gate",
    "They released the version of the work in public",
    "Terms and conditions of use are free to read",
    "A work of general interest, version of the source",
    "Copyright law grants rights to any person",
    "It is permitted to use the software in any form",
    "Creative work for the commons of the city",
    "Fishing licenses are granted by the public office",
    "you may obtain a copy of the following file",
    "the foundation published a free program",
    "a license to distribute beer, wine and more",
    "reserved seats and all other rights",
)
FAMILIES = ("unknown", *TEMPLATES)
_WORDS = regex.compile(r"[\p{L}\p{N}]+").findall
_KEYS = common.mix(np.arange(601, 608, dtype=np.uint64)) | np.uint64(1)

_PAIR = _KEYS[1:3]

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in ("paragraph", "line", "last_line")), T.StructField("family", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("similarity", T.DoubleType()), T.StructField("text", T.StringType())])


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


_PAIRS = {f: [frozenset(zip(x := words(t), x[1:])) for t in ts] for f, ts in TEMPLATES.items()}
LENGTHS = sorted({len(words(t)) for ts in TEMPLATES.values() for t in ts})


def _hashed(h: np.ndarray) -> np.ndarray:
    """Features of words (their hashes): each word, and each pair of neighbours; as many as 2 n - 1."""
    return np.concatenate([h * _KEYS[0], h[:-1] * _PAIR[0] + h[1:] * _PAIR[1]]) >> np.uint64(64 - HASH_BITS)


def features(w: list[str], hashes: common.WordHashes) -> tuple[np.ndarray, np.ndarray]:
    if not w:
        return np.array([BIAS]), np.array([1.0])
    at, n = np.unique(_hashed(hashes(w)).astype(np.int64), return_counts=True)
    return np.append(at, BIAS), np.append(SCALE * n / len(w), 1.0)


def similarity(w: list[str], family: str) -> float:
    """The greatest share of a template's word pairs that the words have."""
    pairs = set(zip(w, w[1:]))
    return max(len(own & pairs) / len(own) for own in _PAIRS[family])


def train(lines: list[str], variations: int = 30, epochs: int = 6, seed: int = 11) -> np.ndarray:
    """Calibrated weights (features and bias by family). lines: of the corpus, taken as unknown unless a template is found in them."""
    random, hashes = np.random.default_rng(seed), common.WordHashes()
    unknown = [w for w in map(words, lines) if w and max(similarity(w, f) for f in TEMPLATES) < 0.4]
    fillers = np.array([x for w in unknown for x in w] or ["the"])
    rows, labels = [], []
    for k, family in enumerate(FAMILIES[1:], 1):
        for t in map(words, TEMPLATES[family]):
            for v in range(variations):
                w = [x for x in t if v == 0 or random.random() > 0.08]
                more = list(random.choice(fillers, size=int(random.integers(0, 2 * len(w) + 1)))) if v % 2 else []
                rows.append([*more[::2], *(["copyright", str(random.integers(1990, 2030))] if v % 5 == 4 else []), *w, *more[1::2]]), labels.append(k)
    vocabulary = [w for ts in TEMPLATES.values() for t in ts for w in words(t)]
    for _ in range(len(rows) // 4):  # words of the notices in no order
        rows.append([*random.choice(vocabulary, size=int(random.integers(1, 6))), *random.choice(fillers, size=int(random.integers(1, 30)))]), labels.append(0)
    for w in (*map(words, STRAY * 8), *unknown):
        rows.append(w), labels.append(0)
    data, labels = [features(w, hashes) for w in rows], np.array(labels)
    apart = random.random(len(rows)) < 0.2
    fit = Ftrl(SIZE + 1, len(FAMILIES), alpha=0.5, l1=0.01, l2=0.001)
    fit.fit([d for d, a in zip(data, apart) if not a], labels[~apart], epochs)
    w = fit.weights()
    return (w / temperature(np.array([x @ w[at] for (at, x), a in zip(data, apart) if a]), labels[apart])).astype(np.float32)


def _pair_hashes(h: np.ndarray) -> np.ndarray:
    return h[:-1] * _PAIR[0] + h[1:] * _PAIR[1]


class Scanner:
    """Finds the notices of texts."""

    def __init__(self, table: np.ndarray, min_score: float, min_similarity: float):
        self.table, self.min_score, self.min_similarity, self.hashes = table.astype(np.float64), min_score, min_similarity, common.WordHashes()
        each = [np.unique(_pair_hashes(self.hashes(words(t)))) for ts in TEMPLATES.values() for t in ts]
        self.pairs = np.unique(np.concatenate(each))
        self.of = np.stack([np.isin(self.pairs, x) for x in each])

    def _known(self, h: np.ndarray) -> np.ndarray:
        """By pair of neighbours: whether a template has it."""
        p = _pair_hashes(h)
        return self.pairs[np.minimum(np.searchsorted(self.pairs, p), len(self.pairs) - 1)] == p

    def _possible(self, h: np.ndarray) -> bool:
        """Whether words (their hashes) have enough of a template to confirm it."""
        p = _pair_hashes(h)
        at = np.minimum(np.searchsorted(self.pairs, p), len(self.pairs) - 1)
        at = np.unique(at[self.pairs[at] == p])
        return bool((self.of[:, at].sum(axis=1) >= self.min_similarity * self.of.sum(axis=1)).any())

    def notices(self, w: list[str]) -> list[tuple[int, int, int, float, float]]:
        """Of one paragraph: first and last word, family, score, similarity."""
        if len(w) < 2:
            return []
        h = self.hashes(w)
        if not self._possible(h):
            return []
        known = self._known(h)
        f = _hashed(h).astype(np.int64)
        one, two = self.table[f[: len(w)]], self.table[f[len(w) :]]
        zero = np.zeros((1, one.shape[1]))
        ones, twos = np.cumsum(np.concatenate([zero, one]), axis=0), np.cumsum(np.concatenate([zero, two]), axis=0)
        hits = np.concatenate([[0], np.cumsum(known)])
        found = []
        for length in {min(n, len(w)) for n in (*LENGTHS, *(3 * n // 2 for n in LENGTHS))}:
            at = np.unique(np.append(np.arange(0, len(w) - length + 1, max(1, length // 6)), len(w) - length))
            at = at[hits[at + length - 1] > hits[at]]
            if length < 2 or not len(at):
                continue
            s = self.table[BIAS] + SCALE / length * (ones[at + length] - ones[at] + twos[at + length - 1] - twos[at])
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = np.argmax(p, axis=1)
            for k in np.flatnonzero((best > 0) & (p[np.arange(len(at)), best] >= self.min_score)):
                a, b = int(at[k]), int(at[k]) + length
                same = similarity(w[a:b], FAMILIES[best[k]])
                if same >= self.min_similarity:
                    pairs = frozenset().union(*_PAIRS[FAMILIES[best[k]]])
                    own = [i for i in range(a, b - 1) if (w[i], w[i + 1]) in pairs]
                    found.append((same, float(p[k, best[k]]), own[0], own[-1] + 1, int(best[k])))
        out, taken = [], np.zeros(len(w), dtype=bool)
        for same, score, a, b, family in sorted(found, key=lambda x: (-x[0], x[3] - x[2], -x[1], x[2])):
            if not taken[a : b + 1].any():
                taken[a : b + 1] = True
                out.append((a, b, family, score, same))
        return sorted(out)

    def __call__(self, text: str) -> list[tuple]:
        """Paragraph, first line, last line, family, score, similarity, text."""
        w = words(text) if text else []
        if len(w) < 2 or not self._possible(self.hashes(w)):
            return []
        out, paragraph, held = [], 0, []
        lines = text.split("\n")
        for k, line in enumerate([*lines, ""]):
            if line.strip():
                held.append(k)
            elif held:
                each = [words(lines[i]) for i in held]
                line_of = np.repeat(held, [len(x) for x in each])
                for a, b, family, score, same in self.notices([x for y in each for x in y]):
                    out.append((paragraph, int(line_of[a]), int(line_of[b]), FAMILIES[family], score, same, "\n".join(lines[line_of[a] : line_of[b] + 1])))
                paragraph, held = paragraph + 1, []
        return out


def scan(docs: DataFrame, min_score: float = 0.5, min_similarity: float = 0.6, sample_lines: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice: its document, paragraph and lines (from 0), family, calibrated score, similarity, text (of its lines)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = rows.select(F.explode(F.split("text", "\n")).alias("text")).filter(F.length(F.trim("text")) > 0)
    shared = spark.sparkContext.broadcast(train([r.text for r in common.first_texts(lines, sample_lines)]))

    def work(batches):
        import pyarrow as pa

        find = Scanner(shared.value, min_score, min_similarity)
        for batch in batches:
            found = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in find(text)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*found)) or [[]] * 8, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string()), strict=True)], names=SCHEMA.names)

    return rows.mapInArrow(common.tidied(work), SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
