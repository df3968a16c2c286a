"""License scans by a positional index of rare words.

A pack of licence texts, notices and identifiers makes the index. How rare a word is comes from the pack and from all
documents: one pass counts, for each word of the pack, the documents that hold it. Of every rule the rarest words of each
stretch are posted with their positions. In a file, stretch by stretch, the words of the index are ranked by that rarity and the highest
are looked up; each posting says where its rule would begin, and postings are intersected by this relative position, with slack for
what was inserted or left out. Where enough agree, the rule is aligned with the file around that place, and it counts if the
coverage is high and every mandatory phrase stands there whole.

Rows are independent: no shuffle of texts. The index has a few thousand words and goes with the function.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import ALNUM, Words, slices


@dataclass(frozen=True)
class Rule:
    """label: what a match stands for; text: of the rule; keys: phrases of it that a match must have whole."""

    label: str
    text: str
    keys: tuple[str, ...] = ()


#: Base phrases: each place where the words stand consecutively counts.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Texts and short notices of well-known licences (fixed values).
RULES = (
    Rule("mit", "released under the mit license", ("mit license",)),
    Rule("mit", "licensed under the mit license", ("mit license",)),
    Rule("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("free of charge", "without restriction")),
    Rule("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Rule("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "www apache org licenses")),
    Rule("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("general public license",)),
    Rule("gpl", "licensed under the gnu general public license", ("general public license",)),
    Rule("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Rule("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    Rule("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Rule("bsd", "licensed under the bsd license", ("bsd license",)),
    Rule("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Rule("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute",)),
    Rule("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Rule("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Rule("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Rule("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    Rule("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("free of charge", "without warranty of any kind")),
    Rule("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice")),
    Rule("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ("permission to use copy modify and or distribute", "the author disclaims all warranties")),
    Rule("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("permission is granted to anyone to use this software for any purpose",)),
    Rule("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("apache license", "on an as is basis without warranties or conditions of any kind")),
    Rule("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("general public license", "in the hope that it will be useful")),
    Rule("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("free and unencumbered software", "in source code form or as a compiled binary")),
    Rule("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", ("any person or organization obtaining a copy",)),
    Rule("mpl", "licensed under the mozilla public license version 2 0", ("mozilla public license",)),
    Rule("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Rule("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Rule("epl", "licensed under the eclipse public license", ("eclipse public license",)),
    Rule("isc", "licensed under the isc license", ("isc license",)),
    Rule("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited", ("unauthorized copying of this file",)),
)


#: Identifiers of short notices, and what they stand for; whole texts in files of this package, with what a match must have (fixed values).
IDENTIFIERS = {
    "mit": ("MIT", "MIT-0"), "apache": ("Apache-2.0", "Apache-1.1"), "gpl": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"), "lgpl": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "agpl": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), "bsd": ("BSD-2-Clause", "BSD-3-Clause"), "mpl": ("MPL-1.1", "MPL-2.0"), "epl": ("EPL-1.0", "EPL-2.0"), "isc": ("ISC",), "cc0": ("CC0-1.0",), "cc-by": ("CC-BY-4.0",), "unlicense": ("Unlicense",), "zlib": ("Zlib",), "boost": ("BSL-1.0",), "artistic": ("Artistic-2.0",),
}
WHOLE = {
    "Apache-2.0": ("apache", ("apache license", "terms and conditions for use reproduction and distribution")), "CC0-1.0": ("cc0", ("waiver", "copyright and related rights")), "GPL-2": ("gpl", ("general public license", "terms and conditions for copying")), "GPL-3": ("gpl", ("general public license", "basic permissions")),
    "LGPL-2.1": ("lgpl", ("lesser general public license",)), "LGPL-3": ("lgpl", ("lesser general public license",)), "MPL-2.0": ("mpl", ("mozilla public license",)), "Artistic": ("artistic", ("artistic license",)),
}
#: Words of a stretch of a rule and of a file; words posted for each stretch of a rule; words looked up in a stretch of a file.
STRETCH, POSTED, LOOKED_UP = 64, 8, 12


def default_rules() -> tuple[Rule, ...]:
    """Notices, identifiers and the whole texts of the package's files."""
    named = (Rule(label, f"SPDX-License-Identifier: {i}", (f"SPDX-License-Identifier: {i}",)) for label, names in IDENTIFIERS.items() for i in names)
    folder = resources.files("tessera.llm") / "licences"
    whole = (Rule(label, (folder / f"{name}.txt").read_text(encoding="utf-8"), keys) for name, (label, keys) in WHOLE.items())
    return (*RULES, *named, *whole)


def _hashes(text: str) -> np.ndarray:
    return Words(pa.array([text]), ALNUM, lower=True).hashes()


class Index:
    """The rules by word hash. held: of the pack's words, in how many of n_docs documents each is; share: part of a rule's posted words that must agree on its place; cover: part of all its words that must be there, in order."""

    def __init__(self, rules: tuple[Rule, ...], phrases: tuple[tuple[str, str], ...] = PHRASES, held: dict[int, int] | None = None, n_docs: int = 0, share: float = 0.3, cover: float = 0.8):
        self.labels, self.cover = [r.label for r in rules], cover
        self.words = [_hashes(r.text).tolist() for r in rules]
        found = Counter(h for w in self.words for h in set(w))
        self.idf = {h: math.log((n_docs + len(rules) + 1) / (n + (held or {}).get(h, 0))) for h, n in found.items()}
        self.keys = [[_hashes(k).tolist() for k in r.keys] or [w] for r, w in zip(rules, self.words, strict=True)]
        #: Words that may be inserted or missing before the place where a rule's word is looked for.
        self.slack = [max(2, len(w) // 5) for w in self.words]
        self.bits = [_bits(w) for w in self.words]
        #: By word: the rules and the positions in them where it is posted; how many positions must agree on a rule's place.
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for r, w in enumerate(self.words):
            posted = 0
            for begin in range(0, len(w), STRETCH):
                stretch = range(begin, min(begin + STRETCH, len(w)))
                first = {w[i]: i for i in reversed(stretch)}
                # of a short one, half of its words, six at most
                most = max(2, min(6, -(-len(first) // 2)), -(-POSTED * len(stretch) // STRETCH))
                for h in sorted(first, key=lambda h: (-self.idf[h], first[h]))[:most]:
                    self.postings[h].append((r, first[h]))
                    posted += 1
            self.needed.append(max(min(2, posted), math.ceil(share * posted)))
        self.posted = np.array(sorted(self.postings), np.uint64)
        self.phrases = [(_hashes(p), label) for p, label in phrases]

    @property
    def vocabulary(self) -> np.ndarray:
        """The hashes of all words of the pack."""
        return np.array(sorted(self.idf), np.uint64)

    def looked_up(self, hashes: np.ndarray, places: np.ndarray) -> list[int]:
        """Of the places of the index's words in a file, those of the rarest words of each stretch of it."""
        out, known = [], hashes[places].tolist()
        edges = np.flatnonzero(np.diff(places // STRETCH, prepend=-1, append=1 << 62))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            ranked = sorted(set(known[a:b]), key=lambda h: (-self.idf[h], h))
            chosen = set(ranked[:LOOKED_UP])
            out += [int(p) for p, h in zip(places[a:b], known[a:b], strict=True) if h in chosen]
        return out

    def matches(self, hashes: np.ndarray, places: np.ndarray) -> list[tuple[str, float]]:
        """Labels and coverage of the rules in one file: its words' hashes, and the places of the index's words."""
        votes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p in self.looked_up(hashes, places):
            for r, q in self.postings[int(hashes[p])]:
                votes[r].append((p - q, q))
        found = []
        for r, own in votes.items():
            width = self.slack[r] + 1
            by: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for begin, q in own:
                by[begin // width].append((begin, q))
            best = 0.0
            for bucket in sorted(by):
                near = by[bucket] + by.get(bucket + 1, [])
                if best < 1 and len({q for _, q in near}) >= self.needed[r]:
                    best = max(best, self.verified(r, sorted(b for b, _ in near)[len(near) // 2], hashes))
            if best:
                found.append((self.labels[r], best))
        return found

    def verified(self, r: int, begin: int, hashes: np.ndarray) -> float:
        """The coverage of a rule that begins about there, if it is high enough and all mandatory phrases stand there; else 0."""
        slack = 2 * self.slack[r]
        around = hashes[max(0, begin - slack) : max(0, begin + len(self.words[r]) + slack)].tolist()
        cover = self.aligned(r, around) / len(self.words[r])
        return cover if cover >= self.cover and all(_stands(k, around) for k in self.keys[r]) else 0.0

    def aligned(self, r: int, around: list[int]) -> int:
        """The most words of a rule that stand among others in its order (a longest common subsequence, a bit for each word of the rule)."""
        full = (1 << len(self.words[r])) - 1
        left, bits = full, self.bits[r]
        for h in around:
            if h in bits:
                hit = left & bits[h]
                left = ((left + hit) | (left - hit)) & full
        return len(self.words[r]) - left.bit_count()


def _bits(words: list[int]) -> dict[int, int]:
    places: dict[int, bytearray] = defaultdict(lambda: bytearray(len(words) // 8 + 1))
    for i, h in enumerate(words):
        places[h][i // 8] |= 1 << i % 8
    return {h: int.from_bytes(b, "little") for h, b in places.items()}


def _stands(phrase: list[int], words: list[int]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def _join(labels: set[str]) -> str:
    return ",".join(sorted(labels))


def _held(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> tuple[dict[int, int], int]:
    """In how many documents each word of the pack is, and how many documents there are: a number a word from each task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(0), ALNUM, lower=True)
                hashes = words.hashes()
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[at] == hashes
                pairs = np.unique(words.text_of[known] * len(vocabulary) + at[known])
                held += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
                n += part.num_rows
        yield pa.RecordBatch.from_pydict({"word": pa.array([-1, *np.flatnonzero(held).tolist()], pa.int32()), "n": pa.array([n, *held[held > 0].tolist()], pa.int64())})

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    n = counts.pop(-1, 0)
    return {int(vocabulary[i]): c for i, c in counts.items()}, n


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] | None = None, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """Licence phrases and notices in every whole text, A-Z lower-cased; words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.

    Returns per row of docs: id_col, n_words, n_base (places where a base phrase stands), first_word and
    last_word (smallest and largest start of one, words from 0; null if none), base_labels and labels
    (distinct, sorted, comma-joined, empty if none; labels has those of verified rules, too), score (the
    best coverage: 1.0 for a base phrase, a rule's share of words in order, 0.0 if nothing is found). A null
    text counts as empty. Repeated rows and ids give a row each; a null id stays null; other columns,
    whatever their names, are not looked at. rules: default_rules() if not given. Which words are looked up depends on how many of docs hold them.
    """
    rules = default_rules() if rules is None else rules
    index = Index(rules, phrases, *_held(docs, text_col, Index(rules, phrases).vocabulary))
    kind = docs.schema[id_col].dataType
    long, text = T.LongType(), T.StringType()
    columns = [("n_words", long), ("n_base", long), ("first_word", long), ("last_word", long), ("base_labels", text), ("labels", text), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(k, t) for k, t in columns)])

    def scan(part: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(part.column(1), ALNUM, lower=True)
        hashes, text_of, room, n = words.hashes(), words.text_of, words.room(), part.num_rows
        n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        base: list[set[str]] = [set() for _ in range(n)]
        for phrase, label in index.phrases:
            at = np.flatnonzero((hashes == phrase[0]) & (room >= len(phrase)))
            for k in range(1, len(phrase)):
                at = at[hashes[at + k] == phrase[k]]
            texts = text_of[at]
            np.add.at(n_base, texts, 1)
            np.minimum.at(first, texts, at - words.first[texts])
            np.maximum.at(last, texts, at - words.first[texts])
            for t in np.unique(texts).tolist():
                base[t].add(label)
        score = np.where(n_base > 0, 1.0, 0.0)
        labels = [set(x) for x in base]
        nearest = np.minimum(np.searchsorted(index.posted, hashes), len(index.posted) - 1)
        rare = np.flatnonzero(index.posted[nearest] == hashes)
        texts = text_of[rare]
        for t in np.unique(texts).tolist():
            lo, hi = np.searchsorted(texts, [t, t + 1])
            begin, stop = words.first[t], words.first[t + 1]
            for label, cover in index.matches(hashes[begin:stop], rare[lo:hi] - begin):
                labels[t].add(label)
                score[t] = max(score[t], cover)
        none = n_base == 0
        arrays = [words.counts, n_base, pa.array(first, mask=none), pa.array(last, mask=none), list(map(_join, base)), list(map(_join, labels)), score]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.RecordBatch.from_arrays([part.column(0), *(x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(arrays, types, strict=True))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[1]):
                yield scan(part)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
