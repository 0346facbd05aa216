"""License scans: named phrases, and an exact set-similarity join of text blocks with license templates.

A text's blocks are windows of BLOCK words, one every STEP words, so any BLOCK - STEP words in a row
are in one block.  A block matches a template (a paragraph of a license) when it holds at least the share
`threshold` of the template's distinct words.  The join is exact and uses the usual filters.  Tokens are ordered by their
frequency over the whole corpus, rare first, on both sides; of a block only the words that any template
has are kept, as no other can be shared.  The first shared token must be one of the first |T| - need + 1 tokens of
the template (prefix filter); the block must have `need` kept tokens at all (length filter); and from the first
shared token on both the template and the block must have `need` (positional filter).
Templates are a fixed, short list, so the side that is indexed is broadcast and no text is shuffled.

Defined results: null and empty texts have no words, no labels, no blocks and score 0; places are null where no phrase
stands; equal rows give equal rows; further columns don't matter; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import blocks, hash_words, split_words, text_bytes, words_of

BLOCK, STEP, THRESHOLD = 96, 32, 0.8
BLOCKS = pa.list_(pa.struct([("first", pa.int64()), ("template", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))

# Phrases with their labels, and paragraphs of common licenses with theirs.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied"),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc", "This work is licensed under a Creative Commons Attribution International License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work"),
    ("apache", "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions"),
    ("bsd", "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("boost", "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version"),
    ("gpl", "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice"),
    ("mpl", "The licenses granted in Section 2.1 with respect to any Contribution become effective for each Contribution on the date the Contributor first distributes such Contribution."),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
)


class Templates:
    def __init__(self, templates, frequency: dict[int, int], threshold: float) -> None:
        self.labels = [label for label, _ in templates]
        sets = [set(hash_words(words_of(text.encode())).tolist()) for _, text in templates]
        self.all = np.array(sorted({x for own in sets for x in own}), np.uint64)
        order = sorted(self.all.tolist(), key=lambda x: (frequency.get(x, 0), x))
        self.rank = {x: k for k, x in enumerate(order)}
        self.tokens = [sorted(self.rank[x] for x in own) for own in sets]
        self.sets = [frozenset(own) for own in self.tokens]
        self.need = [math.ceil(threshold * len(own) - 1e-9) for own in self.tokens]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, own in enumerate(self.tokens):
            for place, x in enumerate(own[: len(own) - self.need[t] + 1]):
                self.prefix.setdefault(x, []).append((t, place))
        self.keys = np.array(sorted(order[x] for x in self.prefix), np.uint64)

    def block(self, words: list[int]) -> list[tuple[int, float]]:
        """(template, containment) of all templates that a block of word hashes matches."""
        own = sorted({self.rank[x] for x in words if x in self.rank})
        met: set[int] = set()
        out = []
        for j, x in enumerate(own):
            for t, i in self.prefix.get(x, ()):
                if t in met:
                    continue
                met.add(t)  # the first token they share
                if len(own) >= self.need[t] and min(len(self.tokens[t]) - i, len(own) - j) >= self.need[t]:
                    have = len(self.sets[t].intersection(own))
                    if have >= self.need[t]:
                        out.append((t, have / len(self.tokens[t])))
        return sorted(out)

    def matches(self, h: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, float]]:
        """(first word of the block, template, containment) of one text; hits are places of prefix tokens."""
        last = max(0, -(-(len(h) - BLOCK) // STEP))
        numbers = {b for p in hits.tolist() for b in range(max(0, -(-(p - BLOCK + 1) // STEP)), min(last, p // STEP) + 1)}
        return [(b * STEP, t, share) for b in sorted(numbers) for t, share in self.block(h[b * STEP : b * STEP + BLOCK].tolist())]


def token_frequencies(docs: DataFrame, text: str, tokens: np.ndarray) -> dict[int, int]:
    """How often each of a fixed list of tokens stands in the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for _, data, offsets in blocks(batch, "text"):
                h = split_words(data, offsets).hash
                at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                n += np.bincount(at[tokens[at] == h], minlength=len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])

    rows = docs.select(text_bytes(text).alias("text")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token & (2**64 - 1): r.n for r in rows}


def scan_licenses(docs: DataFrame, *, id: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: id, n_words, n_base, first_word, last_word, base_labels, labels, score (best containment; a phrase counts as 1),
    blocks (array of struct: first word, number and label of the template, containment), by first word."""
    tokens = Templates(templates, {}, threshold).all
    frequency = token_frequencies(docs, text, tokens)
    kind = docs.schema[id].dataType.simpleString()
    own = docs.select(F.col(id).alias("id"), text_bytes(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(templates, frequency, threshold)
        wanted = [(hash_words(p.encode().split()), label) for p, label in phrases]
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                w = split_words(data, offsets)
                n = part.num_rows
                text_of = w.text_of()
                count = np.zeros(n, np.int64)
                low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: dict[int, set[str]] = {}
                for p, label in wanted:
                    k, size = len(p), len(w.hash)
                    if size < k:
                        continue
                    ok = text_of[: size - k + 1] == text_of[k - 1 :]
                    for j in range(k):
                        ok &= w.hash[j : size - k + 1 + j] == p[j]
                    at = np.flatnonzero(ok)
                    t = text_of[at]
                    np.add.at(count, t, 1)
                    np.minimum.at(low, t, at - w.first[t])
                    np.maximum.at(high, t, at - w.first[t])
                    for x in set(t.tolist()):
                        base.setdefault(x, set()).add(label)
                labels = {t: set(x) for t, x in base.items()}
                score = np.where(count > 0, 1.0, 0.0)
                at = np.minimum(np.searchsorted(index.keys, w.hash), len(index.keys) - 1)
                hits = np.flatnonzero(index.keys[at] == w.hash)
                cut = np.searchsorted(hits, w.first)
                found: list[list] = [[] for _ in range(n)]
                for t in np.unique(text_of[hits]).tolist():
                    a, b = int(w.first[t]), int(w.first[t + 1])
                    for first, m, share in index.matches(w.hash[a:b], hits[cut[t] : cut[t + 1]] - a):
                        found[t].append({"first": first, "template": m, "label": index.labels[m], "containment": share})
                        labels.setdefault(t, set()).add(index.labels[m])
                        score[t] = max(score[t], share)
                none = count == 0
                names = lambda d: pa.array([",".join(sorted(d.get(t, ()))) for t in range(n)], pa.string())
                columns = [part.column("id"), pa.array(np.diff(w.first)), pa.array(count), pa.array(low, pa.int64(), mask=none), pa.array(high, pa.int64(), mask=none), names(base), names(labels), pa.array(score), pa.array(found, BLOCKS)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return own.mapInArrow(scan, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<first:long,template:long,label:string,containment:double>>").withColumnRenamed("id", id)


def license_digest(scanned: DataFrame) -> DataFrame:
    """What scan_licenses returns, its blocks as their number and the SHA-256 of their `first:template`, comma-joined."""
    place = F.transform("blocks", lambda b: F.concat_ws(":", b["first"].cast("string"), b["template"].cast("string")))
    return scanned.select(*[c for c in scanned.columns if c != "blocks"], F.size("blocks").cast("long").alias("n_blocks"), F.sha2(F.array_join(place, ","), 256).alias("blocks_sha256"))


_quoted = lambda t: "'" + t.replace("'", "''") + "'"
_WORDS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format('text')} AS w FROM documents),
p AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {', '.join(f"({_quoted(p)}, {_quoted(label)})" for p, label in PHRASES)}) v(phrase, label)),
e AS MATERIALIZED (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i, len(w) AS n FROM d),
q AS (SELECT d.r, e.i, label FROM e JOIN p ON e.x = p.p[1] JOIN d ON d.r = e.r WHERE d.w[e.i + 1:e.i + len(p.p)] = p.p),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM q GROUP BY r),
t AS (SELECT k, label, list_distinct({_WORDS.format('body')}) AS own FROM (VALUES {', '.join(f"({k}, {_quoted(label)}, {_quoted(body)})" for k, (label, body) in enumerate(TEMPLATES))}) v(k, label, body)),
tw AS (SELECT k, unnest(own) AS x FROM t),
bw AS (SELECT DISTINCT r, c, x FROM (SELECT r, x, i, n, unnest(range(greatest(0, CAST(ceil((i - {BLOCK} + 1) / {STEP}) AS BIGINT)), least(i // {STEP}, greatest(0, CAST(ceil((n - {BLOCK}) / {STEP}) AS BIGINT))) + 1)) AS c FROM e WHERE x IN (SELECT x FROM tw))),
m AS (SELECT r, c, bw_t.k, label, have::DOUBLE / len(own) AS share FROM (SELECT r, c, k, count(*) AS have FROM bw JOIN tw USING (x) GROUP BY r, c, k) bw_t JOIN t ON t.k = bw_t.k WHERE have >= ceil({THRESHOLD}::DOUBLE * len(own) - 1e-9::DOUBLE)),
f AS (SELECT r, count(*) AS n_blocks, string_agg((c * {STEP}) || ':' || k, ',' ORDER BY c, k) AS places, max(share) AS share FROM m GROUP BY r),
l AS (SELECT r, string_agg(label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label, bool_or(base) AS base FROM (SELECT r, label, true AS base FROM q UNION ALL SELECT r, label, false FROM m) GROUP BY r, label) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS DOUBLE) AS first_word, CAST(last_word AS DOUBLE) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
 greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(share, 0.0::DOUBLE)) AS score, CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks, sha256(coalesce(places, '')) AS blocks_sha256
FROM d LEFT JOIN b USING (r) LEFT JOIN f USING (r) LEFT JOIN l USING (r)
"""
