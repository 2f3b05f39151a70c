"""Licence notices by a positional index of rare template words.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of anything beyond ASCII. Templates are short
licence notices and the telling clauses of whole licence texts. The index maps a word to its postings (template, position). How rare a word is comes from its
document frequency over all documents (one pass over the corpus, a count for each template word; it runs when the
scan is built, since the anchors depend on it). A template of n
words may miss ``floor(tolerance * n)`` of them, so the ``floor(tolerance * n) + 1`` rarest positions hold at
least one match wherever it occurs: these are its anchors. For each anchor word of a file the postings are
intersected by relative position: every occurrence proposes where its template would start. A proposal becomes
a match if enough template words stand at their places and the template's mandatory key phrases stand inside.

Base phrases are found exactly, wherever their words stand consecutively, and their labels always stay.

Defined results: null or empty text has 0 words, no labels (empty strings), null places, score 0; repeated rows
give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields

#: The base phrases with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Template notices as (label, words, mandatory key phrases).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("all-rights-reserved", "copyright all rights reserved", ["all rights reserved"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),  # wherever the phrase stands, also far from "copyright"
    # whole licence texts go in clause by clause: a word that somebody put in or left out then costs one clause at most
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["to deal in the software without restriction"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included"]),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise", ["authors or copyright holders be liable"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", ["the author disclaims all warranties"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products"]),
    ("apache-2.0", "you may not use this file except in compliance with the license", ["except in compliance with the license"]),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["distributed on an as is basis"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license as published"]),
    ("gpl-2.0", "either version 2 of the license or at your option any later version", ["either version 2 of the license"]),
    ("gpl-3.0", "either version 3 of the license or at your option any later version", ["either version 3 of the license"]),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ["in the hope that it will be useful"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license as published"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["source code form is subject to the terms"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["authors be held liable"]),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ["altered source versions must be plainly marked"]),
    ("boost", "boost software license version 1 0", ["boost software license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", ["anyone is free to copy modify publish"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["has waived all copyright"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ["attribution noncommercial sharealike"]),
    ("wtfpl", "do what the fuck you want to public license", ["want to public license"]),
]
TOLERANCE = 0.2
_SPACES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Every place where the words of ``phrase`` stand consecutively."""
    out, at, first, n = [], -1, phrase[0], len(phrase)
    while True:
        try:
            at = words.index(first, at + 1)
        except ValueError:
            return out
        if words[at : at + n] == phrase:
            out.append(at)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    idf: tuple[float, ...]
    misses: int


class RareWordIndex:
    """Postings of the anchor words of all templates."""

    def __init__(self, df: dict[bytes, int], n_docs: int, templates=TEMPLATES, tolerance: float = TOLERANCE):
        self.templates: list[Template] = []
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for label, text, keys in templates:
            words = tuple(words_of(text))
            idf = tuple(math.log(1 + (n_docs - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) for w in words)
            misses = math.floor(tolerance * len(words))
            t = Template(label, words, tuple(tuple(words_of(k)) for k in keys), idf, misses)
            for pos in sorted(range(len(words)), key=lambda p: (-idf[p], p))[: misses + 1]:
                self.anchors[words[pos]].append((len(self.templates), pos))
            self.templates.append(t)
        self.words = frozenset(self.anchors)

    def matches(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """(label, start, share of the template's rarity that matched) of every match."""
        if self.words.isdisjoint(words):
            return []
        starts: set[tuple[int, int]] = set()
        for at, w in enumerate(words):
            if w in self.words:
                starts.update((t, at - pos) for t, pos in self.anchors[w])
        out = []
        for t, start in sorted(starts):
            m = self.templates[t]
            there = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(m.words)]
            if there.count(False) > m.misses:
                continue
            inside = words[max(0, start) : start + len(m.words)]
            if all(places(inside, list(k)) for k in m.keys):
                out.append((m.label, start, sum(w for w, ok in zip(m.idf, there, strict=True) if ok) / sum(m.idf)))
        return out


def vocabulary(templates=TEMPLATES) -> frozenset[bytes]:
    return frozenset(w for _, text, _ in templates for w in words_of(text))


def document_frequencies(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> tuple[dict[bytes, int], int]:
    """({word: documents that hold it}, documents) over all rows; the driver gets one number for each template word."""
    known = vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, int] = defaultdict(int)
        for b in batches:
            count[""] += b.num_rows
            for t in b.column(0):
                for w in known.intersection(words_of(t.as_py())):
                    count[w.decode()] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    rows = fields(docs, text=text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found, found.pop(b"", 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row for each row of ``docs``: counts, places, labels, score, and the matches themselves."""
    kind = docs.schema[id_col].dataType.simpleString()
    df, n_docs = document_frequencies(docs, text_col, templates)
    index = RareWordIndex(df, n_docs, templates)
    base = [(words_of(p), label) for p, label in BASE.items()]
    base_words = frozenset(p[-1] for p, _ in base)
    match = pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                words = words_of(t.as_py())
                found = [] if base_words.isdisjoint(words) else [(at, label) for p, label in base for at in places(words, p)]
                own = index.matches(words)
                labels = {label for _, label in found}
                score = max([1.0 if found else 0.0, *(s for *_, s in own)])
                at = [p for p, _ in found]
                rows.append((len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, *_ in own})), min(1.0, score), [{"label": x, "start": p, "share": s} for x, p, s in own]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(match)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    out = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,share:double>>"
    return fields(docs, id=id_col, text=text_col).mapInArrow(run, out)
