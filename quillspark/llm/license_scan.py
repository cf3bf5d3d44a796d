"""License scans by exact set-similarity join (operator 7).

A block is any run of as many words of a document as a template has, over line ends too (``wrapped``). A template's tokens are ordered by
their frequency in all documents, rarest first. A block can hold ``threshold`` of a template's n distinct tokens only if it
holds one of the template's first n - ceil(threshold n) + 1 (prefix filter; counted from the rarest token a block holds enough
are left, so it is the positional filter too), and if its document has as many words (length filter). What passes is counted
exactly: a word counts in the blocks that hold it and no earlier word of the same token, so every block that meets the
threshold is found.
Templates are a short fixed list, so they go to every task; corpus frequencies are summed for their tokens only.

The base labels need no similarity: a phrase counts where its words stand consecutively, over line ends too.

Words: lower-cased A-Z, runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. Defined cases: a null or wordless text has no words, no places
(null first and last word), empty labels and score 0; repeated rows are scanned as often as they occur; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHasher, flat_bytes, slices, table, tidy, words

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The notices that licenses themselves give, and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
]
#: Texts of whole licenses and of their standard headers.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
            "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to "
            "do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
            "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no "
            "event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of "
            "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
                 "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or "
                 "agreed to in writing software distributed under the license is distributed on an as is basis without warranties or "
                 "conditions of any kind either express or implied see the license for the specific language governing permissions and "
                 "limitations under the license"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
              "published by the free software foundation either version 3 of the license or at your option any later version this program is "
              "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
              "or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of "
              "the gnu general public license along with this program if not see https www gnu org licenses"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the "
            "following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and "
            "the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
            "that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
              "with this file you can obtain one at https mozilla org mpl 2 0"),
]
THRESHOLD = 0.8


def _hash(tokens: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(tokens).encode(), np.uint8)
    end = np.cumsum([len(t.encode()) for t in tokens])
    return SpanHasher(data)(np.concatenate(([0], end[:-1])), end)


class Tokens:
    """The distinct tokens of the phrases and templates, numbered; words are found by hash and then compared as bytes."""

    def __init__(self, texts: list[str]):
        self.tokens = sorted({w for t in texts for w in t.split()})
        order = np.argsort(h := _hash(self.tokens))
        self._hash, self._number = h[order], order
        self._bytes = [t.encode() for t in self.tokens]
        self.number = {t: i for i, t in enumerate(self.tokens)}

    def of(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of every word, -1 for other words."""
        h = SpanHasher(low)(start, end)
        at = np.minimum(np.searchsorted(self._hash, h), len(self._hash) - 1)
        hit = np.flatnonzero(self._hash[at] == h)
        found = np.full(len(h), -1, np.int64)
        for k in np.unique(self._number[at[hit]]):
            mine, token = hit[self._number[at[hit]] == k], np.frombuffer(self._bytes[k], np.uint8)
            mine = mine[end[mine] - start[mine] == len(token)]
            same = (low[start[mine][:, None] + np.arange(len(token))] == token).all(1)
            found[mine[same]] = k
        return found


def _frequencies(tokens: Tokens):
    schema = pa.schema([("token", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tokens.tokens), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat_bytes(part.column("text"))
                low, start, end, _ = words(data, offsets)
                if len(start):
                    found = tokens.of(low, start, end)
                    total += np.bincount(found[found >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], schema=schema)

    return tidy(run)


def windows(place: np.ndarray, token: np.ndarray, size: int, template: list[int], threshold: float):
    """Runs of ``size`` words that hold ``threshold`` of the template: the first and last of the template's words in them (as
    indices into ``place``) and their containment. ``place``: ascending places of words, texts being further apart than any
    template is long; ``token``: their numbers; ``template``: token numbers, rarest first."""
    need = math.ceil(threshold * len(template) - 1e-9)
    rare = place[np.isin(token, template[: len(template) - need + 1])]
    none = np.zeros(0, np.int64)
    if not len(rare):
        return none, none, np.zeros(0)
    inside = np.flatnonzero(np.isin(token, template))
    at = np.searchsorted(rare, place[inside])
    near = np.minimum(np.abs(rare[np.minimum(at, len(rare) - 1)] - place[inside]), np.abs(place[inside] - rare[np.maximum(at - 1, 0)]))
    inside = inside[near < size]
    p, t = place[inside], token[inside]
    # A word counts in the blocks that begin after the token's last word before it, and hold it.
    order = np.lexsort((p, t))
    before = np.full(len(p), -1 - 2 * size, np.int64)
    again = t[order][1:] == t[order][:-1]
    before[order[1:][again]] = p[order[:-1][again]]
    begin, end = np.maximum(before + 1, p - size + 1), p + 1
    edge, where = np.unique(np.concatenate((begin, end)), return_inverse=True)
    held = np.cumsum(np.bincount(where, np.concatenate((np.ones(len(p)), np.full(len(p), -1.0)))).round().astype(np.int64))
    hit = np.flatnonzero(held >= need)  # blocks that begin from one edge to before the next
    first = np.searchsorted(p, edge[hit])
    last = np.searchsorted(p, edge[hit + 1] - 1 + size) - 1
    return inside[first], inside[last], held[hit] / len(template)


OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_blocks", pa.int64()),
])
_OUT_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"


def _scan(tokens: Tokens, templates: list[tuple[str, int, list[int]]], phrases: list[tuple[str, list[int]]], threshold: float, wrapped: bool):
    gap = 2 * max(size for _, size, _ in templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = part.num_rows
                data, offsets = flat_bytes(part.column("text"))
                low, start, end, row = words(data, offsets)
                first = np.searchsorted(row, np.arange(rows))
                n_words = np.bincount(row, minlength=rows)
                found = tokens.of(low, start, end) if len(start) else np.zeros(0, np.int64)
                base: list[set] = [set() for _ in range(rows)]
                places = []
                for label, phrase in phrases:
                    n = len(phrase)
                    if len(found) < n:
                        continue
                    hit = np.ones(len(found) - n + 1, bool)
                    for j, t in enumerate(phrase):
                        hit &= found[j : len(found) - n + 1 + j] == t
                    at = np.flatnonzero(hit)
                    at = at[row[at] == row[at + n - 1]]
                    places.append(at)
                    for r in np.unique(row[at]):
                        base[r].add(label)
                at = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
                n_base = np.bincount(row[at], minlength=rows)
                lo = np.searchsorted(row[at], np.arange(rows))
                labels = [set(b) for b in base]
                score, n_blocks = np.zeros(rows), np.zeros(rows, np.int64)
                known = np.flatnonzero(found >= 0)
                if len(known):
                    # Texts (and lines, if blocks end there) are set apart, so that no block reaches from one into the next.
                    ends = offsets if wrapped else np.unique(np.concatenate((np.flatnonzero(data == 10), offsets)))
                    place, owner = known + np.searchsorted(ends, start[known], side="right") * np.int64(gap), row[known]
                    spans = []
                    for label, size, template in templates:
                        need = math.ceil(threshold * len(template) - 1e-9)
                        enough = n_words[owner] >= need
                        mine = np.flatnonzero(enough)
                        lo_, hi_, share = windows(place[mine], found[known[mine]], size, template, threshold)
                        lo_, hi_ = mine[lo_], mine[hi_]
                        np.maximum.at(score, owner[lo_], share)
                        spans.append((lo_, hi_))
                        for r in np.unique(owner[lo_]):
                            labels[r].add(label)
                    begin, end_ = (np.concatenate([x[k] for x in spans]) for k in (0, 1))
                    if len(begin):  # passages: blocks that share words are one
                        order = np.argsort(begin, kind="stable")
                        begin, far = begin[order], np.maximum.accumulate(end_[order])
                        new = np.concatenate(([True], begin[1:] > far[:-1]))
                        n_blocks = np.bincount(owner[begin[new]], minlength=rows)
                columns = [
                    part.column("doc_id").to_pylist(), n_words, n_base,
                    [int(at[lo[r]] - first[r]) if n_base[r] else None for r in range(rows)],
                    [int(at[lo[r] + n_base[r] - 1] - first[r]) if n_base[r] else None for r in range(rows)],
                    [",".join(sorted(b)) for b in base], [",".join(sorted(x)) for x in labels],
                    np.where([bool(b) for b in base], 1.0, score), n_blocks,
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, OUT.types)], schema=OUT)

    return tidy(run)


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """One row a document; ``score``: the largest containment of a template in a block at the threshold, 1 with a base label;
    ``n_blocks``: passages of such blocks, those that share words being one.
    ``wrapped``: blocks run over line ends, as the query wants them; else they end there."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = Tokens([*phrases, *(t for _, t in templates)])
    counts = read.select("text").mapInArrow(_frequencies(tokens), "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequency = {r["token"]: r["n"] for r in counts.collect()}  # a row for each token of the templates
    ordered = [
        (label, len(text.split()), sorted({tokens.number[w] for w in text.split()}, key=lambda k: (frequency.get(k, 0), k))) for label, text in templates
    ]
    wanted = [(label, [tokens.number[w] for w in phrase.split()]) for phrase, label in phrases.items()]
    return read.mapInArrow(_scan(tokens, ordered, wanted, threshold, wrapped), _OUT_DDL)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), [*TEMPLATES, *TEXTS], wrapped=True)
