"""License scans over a positional rare-token index.

Templates are passages of public licences and short notices, each with a *key phrase* that has
to stand in the text.  A word's rarity (IDF) is counted over all documents in a pass of its
own.  The index posts, for each template, the places of its ``top_words`` rarest words.  A
file is then scanned so:

1. The file's words that the index posts, its rarest licence words, are looked up.  A word
   at place p that is posted at place q puts the template's start at p - q.
2. Postings intersect by relative position: a start stays if half of the template's posted
   places at least (two, where there are as many) agree on it.
3. There the mandatory key phrase is verified word by word; a wrong or missing one rejects.
4. Coverage is the IDF-weighted share of template words that stand where the template has
   them; a template matches from ``min_coverage`` on.  It may overhang the text at either end.

A *base* template is a phrase alone.  All its words are posted and all have to agree, so it
matches at just the places where its words stand consecutively.  ``score`` is the best
coverage of any match (0: none).

Defined results: a null or empty text has no words, no labels ('') and null places;
repeated rows give a row each; words of equal IDF are taken in order of spelling; a null id
is an id; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .shared import map_batches

# Base phrases with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices and passages of public licences as (label, key phrase, passage).
TEMPLATES = [
    ("cc-by-nc-4.0", "CC BY NC", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "CC BY ND", "licensed under CC BY-ND 4.0"),
    ("cc-by-sa-4.0", "CC BY SA", "licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "CC BY 4 0", "licensed under CC BY 4.0"),
    ("cc0-1.0", "CC0 1 0", "CC0 1.0 Universal Public Domain Dedication"),
    ("agpl-3.0", "Affero General Public License", "GNU Affero General Public License"),
    ("gpl-2.0", "General Public License version 2", "GNU General Public License version 2"),
    ("gpl-3.0", "General Public License version 3", "this work is licensed under the GNU General Public License version 3"),
    ("lgpl", "Lesser General Public License", "GNU Lesser General Public License"),
    ("mit", "MIT License", "released under the MIT License"),
    ("apache-2.0", "Apache License", "licensed under the Apache License version 2.0"),
    (
        "mit",
        "permission is hereby granted free of charge",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "mit",
        "the above copyright notice and this permission notice shall be included",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "bsd",
        "this software is provided by the copyright holders and contributors as is",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    ),
    (
        "apache-2.0",
        "licensed under the Apache License version 2 0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "apache-2.0",
        "distributed under the License is distributed on an as is basis",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "it under the terms of the GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "gpl",
        "WITHOUT ANY WARRANTY without even the implied warranty",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "lgpl",
        "terms of the GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "agpl-3.0",
        "terms of the GNU Affero General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "mpl-2.0",
        "Mozilla Public License",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "unlicense",
        "unencumbered software released into the public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "altered source versions must be plainly marked as such",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "bsl-1.0",
        "obtaining a copy of the software and accompanying documentation covered by this license",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    (
        "cc0-1.0",
        "waived all copyright and related or neighboring rights",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. The person who associated a work with this deed has waived all copyright and related or neighboring rights to this work.",
    ),
]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def word_hash(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return T.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), T.ALNUM, True).hash


class Index:
    """Postings of each template's rarest words; templates side by side as hashes and weights."""

    def __init__(self, idf: dict[str, float] | None = None, top_words: int = 8, base: dict[str, str] = BASE, templates=TEMPLATES):
        self.vocabulary = sorted({w for t in [*base, *(p for *_, p in templates)] for w in words_of(t)})
        idf = idf or {}
        hash_of = dict(zip(self.vocabulary, word_hash(self.vocabulary), strict=True))
        entries = [(label, words_of(phrase), words_of(phrase), True) for phrase, label in base.items()]
        entries += [(label, words_of(key), words_of(passage), False) for label, key, passage in templates]
        self.label, self.base = [e[0] for e in entries], np.array([e[3] for e in entries])
        self.size = np.array([len(e[2]) for e in entries])
        self.longest = int(self.size.max())
        self.hash = np.zeros((len(entries), self.longest), np.uint64)
        self.weight = np.zeros((len(entries), self.longest))
        self.key = np.zeros((len(entries), 2), np.int64)  # place and size of the key phrase
        self.need = np.zeros(len(entries), np.int64)
        posts: dict[str, list[tuple[int, int]]] = {}
        for t, (_, key, words, is_base) in enumerate(entries):
            self.hash[t, : len(words)] = [hash_of[w] for w in words]
            weight = np.array([idf.get(w, 1.0) for w in words])
            self.weight[t, : len(words)] = weight / weight.sum()
            self.key[t] = next(i for i in range(len(words)) if words[i : i + len(key)] == key), len(key)
            rare = sorted(set(words), key=lambda w: (-idf.get(w, 1.0), w))
            rare = set(rare if is_base else rare[:top_words])
            places = [q for q, w in enumerate(words) if w in rare]
            self.need[t] = len(places) if is_base else max(min(2, len(places)), -(-len(places) // 2))
            for q in places:
                posts.setdefault(words[q], []).append((t, q))
        order = sorted(posts, key=hash_of.get)
        self.table = T.Filter(np.array([hash_of[w] for w in order], np.uint64))
        self.many = np.array([len(posts[w]) for w in order])
        self.first = np.cumsum(self.many) - self.many
        self.posted = np.array([p for w in order for p in posts[w]]).reshape(-1, 2)

    def matches(self, w: T.Words, min_coverage: float):
        """(row, template, first word in the row, coverage) of every match in a block."""
        at, slot = self.table.find(w.hash)
        many = self.many[slot]
        pick = np.repeat(self.first[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        template, place = self.posted[pick].T
        where = np.repeat(at, many)
        row = w.row[where]
        start = where - place - w.first[row] + self.longest  # not below 0
        span = int(w.counts.max(initial=0)) + 2 * self.longest
        spot, votes = np.unique((row * len(self.label) + template) * span + start, return_counts=True)
        row, template, start = spot // span // len(self.label), spot // span % len(self.label), spot % span - self.longest
        stay = votes >= self.need[template]
        row, template, start = row[stay], template[stay], start[stay]

        def stands(q):
            """Whether the templates' words q stand at their places."""
            p = start + q
            inside = (p >= 0) & (p < w.counts[row]) & (q < self.size[template])
            return inside & (w.hash[np.where(inside, w.first[row] + p, 0)] == self.hash[template, np.minimum(q, self.longest - 1)])

        if not len(row):
            return row, template, start, np.zeros(0)
        kept = np.ones(len(row), bool)
        for j in range(int(self.key[:, 1].max())):
            kept &= (j >= self.key[template, 1]) | stands(self.key[template, 0] + j)
        row, template, start = row[kept], template[kept], start[kept]
        cover = sum((stands(np.full(len(row), q)) * self.weight[template, q] for q in range(self.longest)), np.zeros(len(row)))
        kept = self.base[template] | (cover >= min_coverage)
        return row[kept], template[kept], start[kept], np.minimum(cover[kept], 1.0)


class _CountDocuments:
    """Documents that hold each template word."""

    def __call__(self, batches):
        vocabulary = Index().vocabulary
        hashes = word_hash(vocabulary)
        order = np.argsort(hashes)
        table = T.Filter(hashes[order])
        seen, rows = np.zeros(len(order), np.int64), 0
        for b in batches:
            for r0, r1, data, offs in T.blocks(T.column(b, "text")):
                w = T.Words(data, offs, T.ALNUM, True)
                at, i = table.find(w.hash)
                pairs = np.unique(w.row[at] * len(seen) + i)
                seen += np.bincount(pairs % len(seen), minlength=len(seen))
                rows += r1 - r0
        yield pa.RecordBatch.from_pydict({"word": [*(vocabulary[i] for i in order), None], "df": [*seen.tolist(), rows]}, pa.schema([("word", pa.string()), ("df", pa.int64())]))


def rarity(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """IDF of every template word over all documents (as many rows as the templates have words)."""
    docs = docs.select(F.col(text).cast("string").alias("text"))
    df = dict(map_batches(docs, _CountDocuments(), "word string, df long").groupBy("word").agg(F.sum("df")).collect())
    n = df.pop(None, 0) or 0
    return {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, first_word: long, n_words: long, coverage: double>>"
_MATCH = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("coverage", pa.float64())]))


class _Scan:
    def __init__(self, index: Index, min_coverage: float):
        self.index, self.least = index, min_coverage

    def __call__(self, batches):
        x = self.index
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _MATCH)
        for b in batches:
            for r0, r1, data, offs in T.blocks(T.column(b, "text")):
                w = T.Words(data, offs, T.ALNUM, True)
                found: dict[int, list] = {}
                for r, t, s, c in zip(*(v.tolist() for v in x.matches(w, self.least)), strict=True):
                    found.setdefault(r, []).append((s, x.label[t], t, c))
                out = [(0, None, None, "", "", 0.0, [])] * (r1 - r0)
                for r, own in found.items():
                    own.sort()
                    base = [(s, label) for s, label, t, _ in own if x.base[t]]
                    out[r] = (
                        len(base),
                        base[0][0] if base else None,
                        base[-1][0] if base else None,
                        ",".join(sorted({label for _, label in base})),
                        ",".join(sorted({label for _, label, *_ in own})),
                        max(c for *_, c in own),
                        [{"label": label, "first_word": s, "n_words": int(x.size[t]), "coverage": c} for s, label, t, c in own],
                    )
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([T.column(b, "doc_id")[r0:r1], pa.array(w.counts), *cols], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", top_words: int = 8, min_coverage: float = 0.5, idf: dict[str, float] | None = None) -> DataFrame:
    """One row for each document: base places, labels, score and all matches with their spans."""
    index = Index(rarity(docs, text) if idf is None else idf, top_words)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(docs, _Scan(index, min_coverage), SCAN)
