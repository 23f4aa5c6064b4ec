r"""Licence scans with a positional rare-token index.

Texts are folded (A-Z to lower case) and cut into words, runs of
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.

* Base phrases: every place where a phrase's words stand consecutively.
* Templates: each licence notice is indexed by its ``index_words`` words of
  highest inverse document frequency in the corpus (document frequencies are
  counted over all documents).  Of these a file looks up, per template, the
  ``file_words`` rarest that it has; postings (template, position) vote for the
  alignment ``file position - template position``.  Neighbouring alignments (words put
  in, left out, or before each line) are one cluster.  One with enough votes is
  compared word by word at its alignments, else as words in order over its whole
  stretch, and must contain the template's mandatory phrases (in order, with two
  other words between at most); its share of matching words is the match's score.

Results per document: words, base places, labels of both kinds, verified
matches (label, first word, share), and the best share as score.

Edge cases: a NULL text is empty; a document without any place or match has
NULL positions, empty label strings and score 0; ties keep the first template
in order; repeated rows give equal rows; an empty table gives no rows.  Input
columns named like output columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblytics.llm.common import drop_names, extended, map_arrow
from weblytics.llm.hashing import FOLD_AZ, batches_of, text_buffer, word_class, words_of

OUTPUT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "matches array<struct<label:string,word:long,share:double>>, score double")

# Phrases of the contract and their labels
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Fixed values: (label, notice, mandatory phrases)
TEMPLATES = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.",
     ("gnu general public license version 3",)),
    ("gpl-2.0+", "This program is free software; you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or "
     "(at your option) any later version.", ("gnu general public license", "version 2")),
    ("gpl-3.0+", "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version.", ("gnu general public license", "version 3")),
    ("lgpl-2.1+", "This library is free software; you can redistribute it and/or modify it under the terms of the "
     "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
     "License, or (at your option) any later version.", ("gnu lesser general public license",)),
    ("agpl-3.0+", "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the "
     "License, or (at your option) any later version.", ("gnu affero general public license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0", ("apache license version 2 0",)),
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software", ("permission is hereby granted free of charge",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
     ("permission to use copy modify",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
     ("mozilla public license v 2 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain.",
     ("unencumbered software released into the public domain",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
     ("creative commons attribution 4 0",)),
)


@dataclass(frozen=True)
class LicenceOptions:
    #: rarest words of a template that are indexed
    index_words: int = 12
    #: of these, a file's own rarest that vote
    file_words: int = 8
    #: share of a file's voting words that must agree on an alignment
    votes: float = 0.5
    #: share of the template's words that must match there, in order
    share: float = 0.75
    #: neighbouring alignments up to so many words apart are one, ...
    step: int = 3
    #: ... up to so many words in all (words that were put in or left out)
    drift: int = 24


def _words(text: str):
    return words_of(*text_buffer(pa.array([text])), word_class("alnum"), FOLD_AZ).hashes


class _Lookup:
    """Membership of 64-bit hashes in a small sorted set, by a table over their
    low 16 bits first."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.low = np.zeros(1 << 16, dtype=bool)
        self.low[(self.sorted & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of members, their numbers in the set)."""
        if not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.low[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.sorted, hashes[maybe])
        at[at == len(self.sorted)] = 0
        good = self.sorted[at] == hashes[maybe]
        return maybe[good], at[good]


def document_frequencies(docs: DataFrame, text: str, templates=TEMPLATES) -> tuple[dict[int, int], int]:
    """Number of documents that hold each template word (by hash), and of all
    documents: at most one row per template word reaches the driver."""
    lookup = _Lookup(np.concatenate([_words(t) for _, t, _ in templates]))

    def run(batches):
        total, rows = np.zeros(len(lookup.sorted), dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for a, b in batches_of(batch.column(0)):
                words = words_of(*text_buffer(batch.column(0).slice(a, b - a)), word_class("alnum"), FOLD_AZ)
                place, number = lookup.find(words.hashes)
                doc = np.searchsorted(words.first, place, side="right") - 1
                pair = np.unique(doc * len(total) + number)
                total += np.bincount(pair % len(total), minlength=len(total))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.arange(len(total)), -1), pa.int64()), pa.array(np.append(total, rows), pa.int64())],
            ["word", "n"])

    found = map_arrow(docs.select(F.col(f"`{text}`")), run, "word long, n long").groupBy("word").agg(
        F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in found}
    return {int(h): counts.get(i, 0) for i, h in enumerate(lookup.sorted)}, counts.get(-1, 0)


def in_order(words: np.ndarray, template: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    best = np.zeros(len(words) + 1, dtype=np.int64)
    for w in template:
        # a match extends what stands before it; the rest keeps its maximum
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(words == w, best[:-1] + 1, 0)))
    return int(best[-1])


def _contains_near(words: np.ndarray, phrase: np.ndarray, loose: int = 2) -> bool:
    """Whether the phrase's words stand in order with at most ``loose`` others between."""
    if _contains(words, phrase):
        return True
    for start in np.flatnonzero(words == phrase[0]).tolist():
        if in_order(words[start:start + len(phrase) + loose], phrase) == len(phrase):
            return True
    return False


class LicenceIndex:
    """Positional postings of the templates' rarest words."""

    def __init__(self, frequency: dict[int, int], templates=TEMPLATES, phrases=BASE_PHRASES,
                 opt: LicenceOptions = LicenceOptions()):
        self.opt = opt
        self.labels = [label for label, _, _ in templates]
        self.words = [_words(text) for _, text, _ in templates]
        self.keys = [[_words(k) for k in keys] for _, _, keys in templates]
        self.phrases = [(_words(p), label) for p, label in phrases.items()]
        postings: dict[int, list[tuple[int, int]]] = {}
        needed = []
        for t, words in enumerate(self.words):
            distinct = sorted({int(w) for w in words}, key=lambda w: (frequency.get(w, 0), w))
            chosen = set(distinct[:opt.index_words])
            places = [q for q, w in enumerate(words.tolist()) if w in chosen]
            for q in places:
                postings.setdefault(int(words[q]), []).append((t, q))
            needed.append(max(1, int(np.ceil(opt.votes * min(len(chosen), opt.file_words)))))
        self.needed = np.array(needed, dtype=np.int64)
        self.indexed = _Lookup(np.array(sorted(postings), dtype=np.uint64))
        self.postings = [postings[int(h)] for h in self.indexed.sorted]
        # 0 is the rarest word of the corpus
        rank = sorted(postings, key=lambda w: (frequency.get(w, 0), w))
        order = {w: k for k, w in enumerate(rank)}
        self.rank = np.array([order[int(h)] for h in self.indexed.sorted], dtype=np.int64)
        self.firsts = _Lookup(np.array([p[0] for p, _ in self.phrases], dtype=np.uint64))

    def base_places(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, str]]:
        """(document, word position, label) of every base phrase place."""
        out = []
        maybe, _ = self.firsts.find(hashes)
        doc = np.searchsorted(first, maybe, side="right") - 1
        for phrase, label in self.phrases:
            size = len(phrase)
            ok = (hashes[maybe] == phrase[0]) & (maybe + size <= first[doc + 1])
            at, owner = maybe[ok], doc[ok]
            for k in range(1, size):
                same = hashes[at + k] == phrase[k]
                at, owner = at[same], owner[same]
            out += [(d, p, label) for d, p in zip(owner.tolist(), at.tolist())]
        return out

    def alignments(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(document, template, first word position, share) of verified matches."""
        place, number = self.indexed.find(hashes)
        if not len(place):
            return []
        counts = np.array([len(p) for p in self.postings])
        flat = np.array([x for p in self.postings for x in p], dtype=np.int64)
        begin = np.cumsum(counts) - counts
        runs = counts[number]
        source = np.repeat(begin[number] - np.cumsum(runs) + runs, runs) + np.arange(int(runs.sum()))
        template, position = flat[source, 0], flat[source, 1]
        where = np.repeat(place, runs)
        doc = np.searchsorted(first, where, side="right") - 1
        start = where - position
        word = np.repeat(number, runs)
        # of each file and template, the rarest words that the file has; a file with too
        # few of them for a match is left out at once
        n_rank, n_templates = len(self.rank), len(self.words)
        key = (doc * n_templates + template) * n_rank + self.rank[word]
        held = np.unique(key)
        group = np.flatnonzero(np.diff(held // n_rank, prepend=-1))
        sizes = np.diff(np.append(group, len(held)))
        enough = sizes >= self.needed[held[group] // n_rank % n_templates]
        chosen = held[(np.arange(len(held)) - np.repeat(group, sizes) < self.opt.file_words) & np.repeat(enough, sizes)]
        if not len(chosen):
            return []
        at = np.searchsorted(chosen, key)
        at[at == len(chosen)] = 0
        voting = chosen[at] == key
        doc, template, start, word = doc[voting], template[voting], start[voting], word[voting]
        # alignments in order; a file may begin or end inside a template, so one may
        # lie partly outside
        order = np.lexsort((start, template, doc))
        doc, template, start, word = doc[order], template[order], start[order], word[order]
        apart = (np.diff(doc) != 0) | (np.diff(template) != 0) | (np.diff(start) > self.opt.step)
        edges = np.concatenate([[0], np.flatnonzero(apart) + 1, [len(doc)]])
        out = []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            while lo < hi:
                # a cluster spans ``drift`` words at most
                stop = lo + int(np.searchsorted(start[lo:hi], start[lo] + self.opt.drift, side="right"))
                d, t = int(doc[lo]), int(template[lo])
                if stop - lo >= self.needed[t] and len(set(word[lo:stop].tolist())) >= self.needed[t]:
                    out += self._verified(hashes, first, d, t, start[lo:stop])
                lo = stop
        return out

    def _verified(self, hashes, first, d: int, t: int, starts: np.ndarray) -> list[tuple[int, int, int, float]]:
        """The exact alignments of a cluster, or the match in order over all of it."""
        lo, hi = int(first[d]), int(first[d + 1])
        words, out = self.words[t], []
        for s in np.unique(starts).tolist():
            a, b = max(s, lo), min(s + len(words), hi)
            part = hashes[a:b]
            share = float((part == words[a - s:b - s]).sum()) / len(words)
            if share >= self.opt.share and all(_contains(part, key) for key in self.keys[t]):
                out.append((d, t, a, share))
        if out:
            return out
        a, b = max(int(starts[0]), lo), min(int(starts[-1]) + len(words), hi)
        part = hashes[a:b]
        share = in_order(part, words) / len(words)
        if share >= self.opt.share and all(_contains_near(part, key) for key in self.keys[t]):
            out.append((d, t, a, share))
        return out


def _contains(words: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return False
    ok = np.ones(n, dtype=bool)
    for k, w in enumerate(phrase):
        ok &= words[k:n + k] == w
    return bool(ok.any())


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, phrases=BASE_PHRASES,
         opt: LicenceOptions = LicenceOptions(), keep_text: bool = True) -> DataFrame:
    """``docs`` plus the columns of ``OUTPUT``."""
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "matches", "score"]
    docs = drop_names(docs, added)
    frequency, _ = document_frequencies(docs, text, templates)
    # postings of the templates alone
    shared = docs.sparkSession.sparkContext.broadcast((frequency, templates, phrases, opt))
    kept = [c for c in docs.columns if keep_text or c != text]
    match_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [match_type, pa.float64()]

    def run(batches):
        index = LicenceIndex(*shared.value)
        for batch in batches:
            columns = [[] for _ in added]
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in batches_of(column):
                words = words_of(*text_buffer(column.slice(a, b - a)), word_class("alnum"), FOLD_AZ)
                places, found = {}, {}
                for d, p, label in index.base_places(words.hashes, words.first):
                    places.setdefault(d, []).append((p - int(words.first[d]), label))
                for d, t, p, share in index.alignments(words.hashes, words.first):
                    found.setdefault(d, []).append((p - int(words.first[d]), t, share))
                for d, n in enumerate(np.diff(words.first).tolist()):
                    mine, matches = places.get(d, []), sorted(found.get(d, []))
                    starts = [p for p, _ in mine]
                    base = {label for _, label in mine}
                    more = {index.labels[t] for _, t, _ in matches}
                    for c, value in zip(columns, (
                            n, len(mine), min(starts, default=None), max(starts, default=None),
                            ",".join(sorted(base)), ",".join(sorted(base | more)),
                            [{"label": index.labels[t], "word": p, "share": s} for p, t, s in matches],
                            max([s for _, _, s in matches], default=0.0))):
                        c.append(value)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, *map(pa.array, columns, kinds)], [*kept, *added])

    return map_arrow(docs, run, extended(docs.select(*[F.col(f"`{c}`") for c in kept]), OUTPUT))
