"""Licence scan by a positional index of rare tokens.

Licence templates are indexed by word and place. The document frequency of every
template word is counted over all texts; a template is indexed by its rarest
words. Every indexed word of a file is looked up, every pair of a place in the file
and a place in a template votes for one relative position, and where enough of a
template's rare weight agrees the template is compared in place and its
mandatory phrases are verified.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Label, notice, mandatory phrases.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version", ("general public license",)),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", ("general public license", "redistribute")),
    ("lgpl", "licensed under the gnu lesser general public license version", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license version", ("affero general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted",)),
    ("apache", "licensed under the apache license version", ("apache license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("mpl", "subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify",)),
    ("cc-by", "licensed under cc by", ("cc by",)),
    ("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    ("cc", "licensed under a creative commons attribution license", ("creative commons",)),
    ("cc0", "dedicated to the public domain under cc0", ("cc0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("proprietary", "confidential and proprietary information do not distribute", ("confidential and proprietary",)),
    ("reserved", "copyright all rights reserved", ("all rights reserved",)),
    # sentences from the bodies of licences
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("endorse or promote products",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("agreed to in writing",)),
    ("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", ("irrevocable copyright license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software foundation", "general public license")),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", ("verbatim copies of this license document",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ("source code form is subject",)),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("altered source versions",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("accompanying documentation covered by this license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("odbl", "made available under the open database license", ("open database license",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", ("creative commons attribution noncommercial",)),
)
#: Rarest words that index a template.
INDEXED = 3
#: Share of a template's indexed weight that must agree on a position, and of its whole weight that must match there.
AGREE, MATCH = 0.5, 0.6

#: Lower case for A-Z; every other ASCII character that is no letter or digit ends a word.
_FOLD = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def _words(phrase: str) -> tuple[bytes, ...]:
    return tuple(phrase.encode().split())


VOCABULARY = frozenset(w for _, notice, keys in TEMPLATES for x in (notice, *keys) for w in _words(x)) | {w for p in BASE for w in _words(p)}


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Texts in all, and those with each licence word: counted over every text,
    a bounded number of words, combined before the shuffle."""

    @F.pandas_udf("array<string>")
    def present(batch: pd.Series) -> pd.Series:
        # the blank stands for the text itself
        return pd.Series([[" ", *(w.decode() for w in VOCABULARY.intersection(words_of(t)))] for t in batch], dtype=object)

    counts = dict(docs.select(F.explode(present(F.col(text))).alias("w")).groupBy("w").count().collect())
    return counts.pop(" ", 0), {w.encode(): n for w, n in counts.items()}


@dataclass
class Index:
    """Inverse document frequencies, postings of the rare words, and for each
    phrase its rarest word with its place."""

    idf: dict[bytes, float]

    def __post_init__(self):
        self.templates = [(label, _words(notice), [_words(k) for k in keys]) for label, notice, keys in TEMPLATES]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.rare_weight = []
        for t, (_, notice, _) in enumerate(self.templates):
            rare = sorted(set(notice), key=lambda w: (-self.idf[w], w))[:INDEXED]
            self.rare_weight.append(sum(self.idf[w] for w in rare))
            for q, w in enumerate(notice):
                if w in rare:
                    self.postings[w].append((t, q))
        self.anchors: dict[bytes, list[tuple[int, tuple[bytes, ...], str]]] = defaultdict(list)
        for phrase, label in BASE.items():
            p = _words(phrase)
            at = max(range(len(p)), key=lambda i: (self.idf[p[i]], -i))
            self.anchors[p[at]].append((at, p, label))
        self.wanted = frozenset(self.postings) | frozenset(self.anchors)

    @staticmethod
    def build(texts: int, frequencies: dict[bytes, int]) -> Index:
        return Index({w: math.log((texts + 1) / (frequencies.get(w, 0) + 1)) + 1e-6 for w in VOCABULARY})

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        places: dict[bytes, list[int]] = {}
        if not self.wanted.isdisjoint(words):
            for i, w in enumerate(words):
                if w in self.wanted:
                    places.setdefault(w, []).append(i)
        base: list[tuple[int, str]] = []
        for w in places.keys() & self.anchors.keys():
            for at, phrase, label in self.anchors[w]:
                base += [(i - at, label) for i in places[w] if i >= at and tuple(words[i - at : i - at + len(phrase)]) == phrase]
        found: dict[str, float] = {}
        for (t, start), weight in self.votes(places).items():
            if weight >= AGREE * self.rare_weight[t] and (share := self.verified(words, t, start)) >= MATCH:
                label = self.templates[t][0]
                found[label] = max(found.get(label, 0.0), share)
        labels = {label for _, label in base}
        at = [i for i, _ in base]
        score = max([*found.values(), *(1.0 for _ in base[:1])], default=0.0)
        return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found.keys())), score

    def votes(self, places: dict[bytes, list[int]]) -> dict[tuple[int, int], float]:
        votes: dict[tuple[int, int], float] = defaultdict(float)
        for w in sorted(places.keys() & self.postings.keys(), key=lambda w: (-self.idf[w], w)):
            for i in places[w]:
                for t, q in self.postings[w]:
                    votes[t, i - q] += self.idf[w]
        return votes

    def verified(self, words: list[bytes], t: int, start: int) -> float:
        """Share of the template's weight found in place; 0 if a mandatory phrase isn't there."""
        _, notice, keys = self.templates[t]
        here = [words[start + q] if 0 <= start + q < len(words) else b"" for q in range(len(notice))]
        near = words[max(0, start - 2) : max(0, start + len(notice) + 2)]
        if not all(any(tuple(near[i : i + len(k)]) == k for i in range(len(near) - len(k) + 1)) for k in keys):
            return 0.0
        total = sum(self.idf[w] for w in notice)
        return sum(self.idf[w] for w, x in zip(notice, here, strict=True) if w == x) / total


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base (places of base phrases),
    first_word and last_word (their least and greatest start; null if none),
    base_labels, labels (with those of verified templates), score (1 with a base
    phrase, else the best template's matched weight share, 0 if none).

    Null and empty texts have no words and no labels. Rows are independent but
    for the frequencies, which count repeated rows as often as they occur; null ids and an
    empty table need no care; only the two named columns are read."""
    index = Index.build(*document_frequencies(docs, text))

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            out = pd.DataFrame([index.scan(t) for t in batch], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("r")).select("doc_id", "r.*")
