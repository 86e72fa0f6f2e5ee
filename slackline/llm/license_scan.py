"""Licence scan by a positional index of rare licence words.

A notice is a list of clauses, a clause its words with their positions; one clause of each notice holds a phrase that
must stand there word for word. The document frequency of every licence word is counted over the whole corpus. In a
file, the words of a clause that occur in it are ranked by IDF, and the highest of them are looked up: each place tells
where the clause would begin, and places are intersected by that beginning. With a clause of n words of which
`need` must match, n - need + 2 looked-up words suffice for two of them to agree wherever the clause stands, so nothing
that would verify is missed. Verified is every word of the clause, and the mandatory phrase.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import CHUNK, WordHasher
from ._shared import binaries, small_batches

#: All ASCII but letters and digits (after A-Z is lower-cased).
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

#: Base phrases and labels (fixed values).
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Clauses of well-known licences and notices, after the label and the phrase that must stand in one of them (fixed values).
NOTICES = (
    ("agpl", "gnu affero general public license", ("gnu affero general public license", "if your software can interact with users remotely through a computer network you should also make sure that it provides a way for users to get its source")),
    (
        "apache-2",
        "apache license version 2",
        (
            "licensed under the apache license version 2 0 the license",
            "you may not use this file except in compliance with the license",
            "you may obtain a copy of the license at http www apache org licenses license 2 0",
            "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
            "without warranties or conditions of any kind either express or implied",
            "see the license for the specific language governing permissions and limitations under the license",
        ),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms",
        (
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
            "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
            "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
            "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
            "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        ),
    ),
    ("bsl-1", "boost software license version 1 0", ("boost software license version 1 0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license")),
    ("cc-by", "creative commons attribution 4 0 international", ("licensed under a creative commons attribution 4 0 international license",)),
    ("cc-by-nc", "creative commons attribution noncommercial", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "creative commons attribution sharealike", ("creative commons attribution sharealike",)),
    ("cc0", "waived all copyright and related or neighboring rights", ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",)),
    (
        "gpl",
        "gnu general public license",
        (
            "gnu general public license",
            "this program is free software you can redistribute it and or modify it under the terms of the",
            "as published by the free software foundation either version 3 of the license or at your option any later version",
            "this program is distributed in the hope that it will be useful but without any warranty",
            "without even the implied warranty of merchantability or fitness for a particular purpose",
        ),
    ),
    (
        "isc",
        "with or without fee is hereby granted",
        (
            "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
            "provided that the above copyright notice and this permission notice appear in all copies",
            "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
            "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
        ),
    ),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the")),
    (
        "mit",
        "permission is hereby granted free of charge",
        (
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software",
            "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
            "and to permit persons to whom the software is furnished to do so subject to the following conditions",
            "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
            "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
            "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
            "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ),
    ),
    ("mpl-2", "mozilla public license v 2 0", ("this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at")),
    (
        "unlicense",
        "free and unencumbered software",
        (
            "this is free and unencumbered software released into the public domain",
            "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ),
    ),
    (
        "zlib",
        "in no event will the authors be held liable",
        (
            "this software is provided as is without any express or implied warranty",
            "in no event will the authors be held liable for any damages arising from the use of this software",
            "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
            "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
            "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
            "this notice may not be removed or altered from any source distribution",
        ),
    ),
)
AGREEING = 2
SHARE = 0.75


@dataclass
class Clause:
    notice: int
    words: list[str]
    key: list[int]  # positions of the mandatory phrase, if it stands here
    need: int  # words that must match
    base: bool
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def clauses(notices=NOTICES) -> tuple[list[str], list[Clause]]:
    """(labels of the notices, their clauses); base phrases are notices of one clause that must stand word for word."""
    known = [(label, phrase, (phrase,), True) for label, phrase in BASE] + [(label, key, parts, False) for label, key, parts in notices]
    out = []
    for i, (label, key, parts, base) in enumerate(known):
        phrase = key.split()
        for part in parts:
            words = part.split()
            at = next((k for k in range(len(words)) if words[k : k + len(phrase)] == phrase), None)
            out.append(Clause(i, words, [] if at is None else list(range(at, at + len(phrase))), len(words) if base else math.ceil(SHARE * len(words)), base))
        if not any(c.key for c in out if c.notice == i):
            raise ValueError(f"{label}: no clause holds {key!r}")
    hasher = WordHasher(SEPARATORS)
    for c in out:
        c.hashes = hasher.words([" ".join(c.words).encode()])[0]
    return [k[0] for k in known], out


def _hashed(batches, hasher: WordHasher):
    for b in batches:
        texts = binaries(b.column("text"))
        for i, j in hasher.chunks(texts, CHUNK):
            words, first = hasher.words(texts[i:j])
            yield b.slice(i, j - i), words, first


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each of the (sorted) word hashes occurs, and how many there are."""

    def run(batches):
        total, docs_seen = np.zeros(len(vocabulary), np.int64), 0
        for _, words, first in _hashed(batches, WordHasher(SEPARATORS)):
            k = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            at = np.flatnonzero(vocabulary[k] == words)
            doc = np.searchsorted(first, at, side="right") - 1
            pairs = np.unique(doc * np.int64(len(vocabulary)) + k[at])
            total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            docs_seen += len(first) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1, dtype=np.int32)), pa.array(np.append(total, docs_seen))], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows:
        out[r["word"]] = r["n"]
    return out[:-1], int(out[-1])


class Scanner:
    """The clauses' words by IDF, and their places in a chunk of documents."""

    def __init__(self, known: list[Clause], vocabulary: np.ndarray, frequency: np.ndarray, n_docs: int):
        self.clauses, self.vocabulary = known, vocabulary
        idf = np.log((n_docs + 1) / (frequency + 1))
        self.numbers = [np.searchsorted(vocabulary, c.hashes) for c in known]
        self.order = [np.lexsort((np.arange(len(n)), -idf[n])) for n in self.numbers]  # positions, rarest first

    def scan(self, words: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For documents with verified places: (clause, first word in the document, words that match)."""
        k = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[k] == words)
        word, doc = k[at], np.searchsorted(first, at, side="right") - 1
        present = np.zeros((len(first) - 1, len(self.vocabulary)), bool)
        present[doc, word] = True
        by_word = np.argsort(word, kind="stable")
        at, doc = at[by_word], doc[by_word]
        bounds = np.searchsorted(word[by_word], np.arange(len(self.vocabulary) + 1))
        out: dict[int, list[tuple[int, int, int]]] = {}
        for i, c in enumerate(self.clauses):
            here = present[:, self.numbers[i]]
            able = (here.sum(1) >= c.need) & here[:, c.key].all(1)
            if not able.any():
                continue
            agreeing = min(AGREEING, c.need)
            ranked = here[:, self.order[i]]
            use = np.zeros_like(here)  # each file's own highest words of the clause
            use[:, self.order[i]] = ranked & (np.cumsum(ranked, axis=1) <= len(c.words) - c.need + agreeing) & able[:, None]
            starts = []
            for p, w in enumerate(self.numbers[i]):
                if use[:, p].any():
                    lo, hi = bounds[w], bounds[w + 1]
                    starts.append(at[lo:hi][use[doc[lo:hi], p]] - p)
            s, votes = np.unique(np.concatenate(starts), return_counts=True)
            s = s[votes >= agreeing]
            if not len(s):
                continue
            for d, start, n in self.verified(c, words, first, s):
                out.setdefault(d, []).append((i, start, n))
        return out

    def verified(self, c: Clause, words: np.ndarray, first: np.ndarray, s: np.ndarray) -> list[tuple[int, int, int]]:
        """Places whose words match; a place is tried in each document that its words touch."""
        low = np.searchsorted(first, np.maximum(s, 0), side="right") - 1
        high = np.searchsorted(first, np.minimum(s + len(c.words) - 1, len(words) - 1), side="right") - 1
        n = high - low + 1
        s, d = np.repeat(s, n), np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        index = s[:, None] + np.arange(len(c.words))
        inside = (index >= first[d][:, None]) & (index < first[d + 1][:, None])
        same = inside & (words[np.clip(index, 0, len(words) - 1)] == c.hashes)
        good = np.flatnonzero((same.sum(1) >= c.need) & same[:, c.key].all(1))
        return [(int(d[j]), int(s[j] - first[d[j]]), int(same[j].sum())) for j in good]


OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,share:double>>"


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices=NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) per row.

    Words are counted over the whole text from 0; base places are those of the base phrases, and
    matches has every verified place of a clause, with the share of its words that match (a start before the text's first
    word has its first words missing). A label is given where the clause with the mandatory phrase stands. score is
    the largest share of a labelled notice's words that match, each clause at its best place (0 without a label). A
    null or empty text has no words; null ids and repeated rows stay as they are; equal
    places of several clauses all count; labels are distinct and sorted. An empty table gives no
    rows. Only the two named columns are read. Two narrow passes over the texts: one counts the licence
    words' document frequencies (one row for each task and word), one scans.
    """
    small_batches(docs.sparkSession)
    names_of, known = clauses(notices)
    total = np.zeros(len(names_of), np.int64)
    for c in known:
        total[c.notice] += len(c.words)
    vocabulary = np.unique(np.concatenate([c.hashes for c in known]))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    frequency, n_docs = document_frequencies(source, vocabulary)

    def judged(found):
        """(base places, base labels, labels, score) of one document's places."""
        best: dict[int, int] = {}
        for i, _, n in found:
            best[i] = max(n, best.get(i, 0))
        granted = {known[i].notice for i in best if known[i].key}
        share = {g: sum(n for i, n in best.items() if known[i].notice == g) / total[g] for g in granted}
        base = {known[i].notice for i, _, _ in found if known[i].base}
        join = lambda of: ",".join(sorted({names_of[g] for g in of}))
        return [s for i, s, _ in found if known[i].base], join(base), join(granted), float(max(share.values(), default=0.0))

    def run(batches):
        scanner = Scanner(known, vocabulary, frequency, n_docs)
        for rows, words, first in _hashed(batches, WordHasher(SEPARATORS)):
            hits = scanner.scan(words, first) if len(words) else {}
            n = rows.num_rows
            count, low, high, base, labels, score, matches = [0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n, [[] for _ in range(n)]
            for d, found in hits.items():
                own, base[d], labels[d], score[d] = judged(found)
                if own:
                    count[d], low[d], high[d] = len(own), min(own), max(own)
                matches[d] = [{"label": names_of[known[i].notice], "start": s, "share": m / len(known[i].words)} for i, s, m in sorted(found, key=lambda x: (x[1], x[0]))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())])))
            cols = (np.diff(first), count, low, high, base, labels, score, matches)
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *names])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, {OUT}")
