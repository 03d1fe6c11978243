"""License scan with a positional rare-token index.

Templates are word lists of licence notices. The index holds, for every
template word, its postings (template, position), and the word's inverse
document frequency over the whole corpus. For each file the licence words are
looked up from the highest IDF on. A template's anchors are its rarest words,
one more than may be missing, so a match holds at least one of them. The
places of an anchor word in the file, less its position in the template, are
the starts to try; then the postings of the template's other words are
intersected with them by relative position, the rarest first, and a start goes
as soon as too many words are missing. What stays must hold the template's
mandatory key phrases, word for word, inside the aligned place.

A template tolerates ``1 - min_coverage`` of missing words. Words inserted or
dropped move the words after them: a word counts up to ``SHIFT`` places away
from its own. Starts within ``SHIFT`` of each other are one match, the one with
most words, then most of them in their own places, then the smallest start. An
exact template (no key phrases) has all its words in their places, and each of
its places is a match.

Words are ASCII letters and digits and all other characters from U+0080, A-Z
lower-cased. Null and empty texts have no words and no labels. Ties in IDF go
to the smaller word; the IDF decides the order of the work only, never the
result. Repeated rows are scanned each; every text is read whole, however
long. An empty table gives no rows. Columns beside doc_id and text are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import alnum_words, chunks, pylist


SHIFT = 2       # how far inserted or dropped words may move a word


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key_phrases: tuple[str, ...] = ()   # () : the whole text, an exact template
    min_coverage: float = 0.8
    base: bool = False

    @property
    def words(self) -> list[bytes]:
        return alnum_words(self.text)

    @property
    def phrases(self) -> list[list[bytes]]:
        return [alnum_words(p) for p in self.key_phrases or (self.text,)]

    @property
    def may_change(self) -> int:
        """How many words of a match may be missing."""
        return math.floor((1 - self.min_coverage) * len(self.words) + 1e-9) if self.key_phrases else 0


# The base phrases and their labels.
BASE_TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)

# Sentences of public licence notices.
NOTICE_TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the License", ("except in compliance with the license",)),
    Template("mit", "Released under the MIT License", ("mit license",), 0.6),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",), 0.7),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",), 0.7),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",), 0.5),
    Template("agpl-3.0", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",), 0.5),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)


@dataclass
class Match:
    template: Template
    start: int
    coverage: float


@dataclass
class Index:
    """Postings and IDF of the templates' words."""

    templates: tuple[Template, ...]
    idf: dict[bytes, float]

    def __post_init__(self) -> None:
        self.phrases = [t.phrases for t in self.templates]
        self.may_change = [t.may_change for t in self.templates]
        self.shift = [SHIFT if t.key_phrases else 0 for t in self.templates]
        self.size = [len(t.words) for t in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, t in enumerate(self.templates):
            for at, w in enumerate(t.words):
                self.postings[w].append((i, at))
        # words by falling IDF; every template's postings in that order
        self.rarest = sorted(self.postings, key=lambda w: (-self.idf.get(w, math.inf), w))
        self.by_rarity: list[list[tuple[bytes, int]]] = [[] for _ in self.templates]
        for w in self.rarest:
            for i, at in self.postings[w]:
                self.by_rarity[i].append((w, at))

    def scan(self, words: list[bytes]) -> list[Match]:
        """Matches in a file's words, by template and place."""
        places: dict[bytes, list[int]] = {}
        for p, w in enumerate(words):
            if w in self.postings:
                places.setdefault(w, []).append(p)
        out = []
        for i, t in enumerate(self.templates):
            for start, missing in self._kept(i, self._intersect(i, places)):
                if self._has_phrases(i, start, words):
                    out.append(Match(t, start, 1 - missing / self.size[i]))
        return sorted(out, key=lambda m: (m.template.label, m.template.text, m.start))

    def _intersect(self, i: int, places: dict[bytes, list[int]]) -> dict[int, tuple[int, int]]:
        """Starts where at most ``may_change`` of the template's words are
        missing: (missing words, words out of place)."""
        most, shift = self.may_change[i], self.shift[i]
        alive: dict[int, list[int]] = {}
        absent = 0      # words that the file does not hold at all
        for k, (w, at) in enumerate(self.by_rarity[i]):
            here = places.get(w)
            if here is None:
                absent += 1
                if absent > most:
                    return {}
            if k <= most:       # an anchor: a start met here first has missed the anchors before
                for p in here or ():
                    for start in range(p - at - shift, p - at + shift + 1):
                        if start not in alive:
                            alive[start] = [k, 0]
            elif not alive:
                return {}
            near = [] if here is None else {p - at + d for p in here for d in range(-shift, shift + 1)}
            exact = {p - at for p in here} if here else ()
            gone = []
            for start, n in alive.items():
                if start not in near:
                    n[0] += 1
                    if n[0] > most:
                        gone.append(start)
                elif start not in exact:
                    n[1] += 1
            for start in gone:
                del alive[start]
        return {start: (n[0], n[1]) for start, n in alive.items()}

    def _kept(self, i: int, found: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
        """(start, missing) of the matches: the best of the starts that lie
        within ``shift`` of each other."""
        taken: set[int] = set()
        out = []
        for start in sorted(found, key=lambda s: (found[s], s)):
            if start not in taken:
                out.append((start, found[start][0]))
                taken.update(range(start - self.shift[i], start + self.shift[i] + 1))
        return out

    def _has_phrases(self, i: int, start: int, words: list[bytes]) -> bool:
        lo, hi = max(0, start - self.shift[i]), min(len(words), start + self.size[i] + self.shift[i])
        return all(any(words[p:p + len(phrase)] == phrase for p in range(lo, hi - len(phrase) + 1)) for phrase in self.phrases[i])


def corpus_idf(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> dict[bytes, float]:
    """IDF over all documents of every template word."""
    vocabulary = frozenset(w for t in templates for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, Counter()
        for b in batches:
            for t in pylist(b, text):
                n += 1
                df.update(vocabulary.intersection(alnum_words(t)))
        yield pa.RecordBatch.from_pydict({"word": pa.array([None, *df], pa.binary()), "n": pa.array([n, *df.values()], pa.int64())})

    rows = docs.select(F.col(text)).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    df = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in rows}
    return {w: math.log((1 + df.get(None, 0)) / (1 + df.get(w, 0))) for w in vocabulary}


RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, matches array<struct<label:string,start:long,coverage:double>>")


def scan_documents(docs: DataFrame, templates: tuple[Template, ...] = BASE_TEMPLATES + NOTICE_TEMPLATES, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, the base phrases' places (n_base, first
    and last word), base_labels, labels, score (the best coverage of a
    template, 0 without one) and every match."""
    held = docs.sparkSession.sparkContext.broadcast(Index(templates, corpus_idf(docs, templates, text)))
    names = [x.split()[0] for x in RESULT.split(", ")]
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("coverage", pa.float64())]))
    types = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        for b in chunks(batches, text, 8 << 20, 4096):
            out: list[list] = [[] for _ in names]
            for doc_id, t in zip(pylist(b, "doc_id"), pylist(b, text)):
                words = alnum_words(t)
                matches = index.scan(words)
                base = [m for m in matches if m.template.base]
                starts = [m.start for m in base]
                row = (doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
                       ",".join(sorted({m.template.label for m in base})), ",".join(sorted({m.template.label for m in matches})),
                       max((m.coverage for m in matches), default=0.0), [{"label": m.template.label, "start": m.start, "coverage": m.coverage} for m in matches])
                for col, x in zip(out, row):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, RESULT)
