"""Licence scan with a generalised suffix automaton of licence texts.

The automaton holds every run of words of every template.  A document's words stream
through it once and give, at each word, the longest run that ends there and occurs in
some template.  Its suffix links lead to the shortest run of that end that still counts,
and so to every place of every template where such a run ends: these are the pairs
(document place, template place) of all common runs, whichever template holds the
longest.  They are chained, per template and in order on both sides, into spans; the
share of a template's words that a chain covers is its coverage.

Some words tell a licence from one that reads much the same (``telling``), or name it
(``NAMING``).  A chain holds all such words of its template, and steps over no word of the
document that tells: "CC BY-ND" is not "CC BY" with a word too many.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect, bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from lumenpeak.llm.common import TERM, UPPER

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package

# Phrases that name a licence wherever they stand, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Public notices, by label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
            "(at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
             "License, or (at your option) any later version"),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
             "License, or (at your option) any later version"),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("bsd", "Released under the BSD License"),
    ("isc", "Released under the ISC License"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
            "License v2.0"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
             "be held liable for any damages arising from the use of this software"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                  "modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
            "to this work"),
    ("cc0", "Licensed under CC0 1.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    *[("-".join(["cc-by", *short]), "This work is licensed under a Creative Commons "
       + "-".join(["Attribution", *long]) + " 4.0 International License") for short, long in (
        ((), ()), (("nc",), ("NonCommercial",)), (("sa",), ("ShareAlike",)), (("nd",), ("NoDerivatives",)),
        (("nc", "sa"), ("NonCommercial", "ShareAlike")), (("nc", "nd"), ("NonCommercial", "NoDerivatives")))],
]
# Words that name a licence.
NAMING = set("mit apache gnu mozilla eclipse creative cc cc0 bsd isc".split())
# Templates of different labels that differ in at most so many words read much the same.
ALIKE = 4
# A run counts from so many words; a chain labels from this coverage; runs of one
# chain stand at most so many words apart.
MIN_RUN, MIN_COVER, MAX_GAP = 2, 0.8, 12
WORDS = re.compile(TERM)
LOWER = str.maketrans(UPPER, UPPER.lower())
SCHEMA = ("doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double, spans array<struct<label:string,start:bigint,stop:bigint,coverage:double>>")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(LOWER))


class Automaton:
    """Generalised suffix automaton over word numbers.

    ``ends[s]`` maps each template to the places behind all occurrences of the state's
    runs in it; ``phrases[s]`` are the base phrases that end any run of the state.
    """

    def __init__(self, texts: list[list[str]], phrases: list[list[str]]):
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in [*texts, *phrases] for w in t))}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        n = len(texts)
        for t, text in enumerate([*texts, *phrases]):
            last = 0
            for at, word in enumerate(text):
                last = self._extend(last, self.vocabulary[word])
                if t < n:
                    self.ends[last].setdefault(t, set()).add(at + 1)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            for t, places in self.ends[s].items():
                self.ends[self.link[s]].setdefault(t, set()).update(places)
        self.phrases: list[tuple[int, ...]] = [()] * len(self.next)
        own: dict[int, list[int]] = {}
        for i, p in enumerate(phrases):
            s = 0
            for word in p:
                s = self.next[s][self.vocabulary[word]]
            own.setdefault(s, []).append(i)
        self.sizes = [len(p) for p in phrases]
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.phrases[s] = (*self.phrases[self.link[s]], *own.get(s, ()))

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def shortest(self, least: int = MIN_RUN) -> list[int]:
        """Per state, the state up its suffix links whose runs are the shortest of at least
        ``least`` words; the state itself if it has none so long."""
        out = list(range(len(self.next)))
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[self.link[s]] >= least:
                out[s] = out[self.link[s]]
        return out

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Base phrases as (start, phrase), and matching statistics as (stop, length, state):
        the longest run that ends before ``stop``, where there is one."""
        found, runs = [], []
        moves, link, length, phrases = self.next, self.link, self.length, self.phrases
        s = n = 0
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                s = n = 0
                continue
            to = moves[s].get(c)
            if to is None:
                while s and to is None:
                    s = link[s]
                    to = moves[s].get(c)
                n = length[s]
                if to is None:
                    s = n = 0
                    continue
            s, n = to, n + 1
            runs.append((i + 1, n, s))
            if phrases[s]:
                found += [(i + 1 - self.sizes[p], p) for p in phrases[s] if self.sizes[p] <= n]
        return found, runs


def pairs(runs: list[tuple[int, int, int]], machine: Automaton, shortest: list[int],
          least: int = MIN_RUN) -> dict[int, dict[int, set[int]]]:
    """Per template, by document place, the places of the template on a common run of at
    least ``least`` words.  Every such run is the overlap of those of that length."""
    out: dict[int, dict[int, set[int]]] = {}
    for stop, n, state in runs:
        if n >= least:
            for t, ends in machine.ends[shortest[state]].items():
                found = out.setdefault(t, {})
                for end in ends:
                    for k in range(1, least + 1):
                        found.setdefault(stop - k, set()).add(end - k)
    return out


def chained(found: dict[int, set[int]], marks: list[int], barred: list[int],
            gap: int = MAX_GAP) -> list[tuple[int, int, int]]:
    """(words, start, stop) of the best chain that ends at each pair.

    A chain goes up in both places and holds every place in ``marks`` of the template;
    words of the document that follow each other in it stand at most ``gap`` words apart,
    with none of the places in ``barred`` between them.  The best has most words, then the
    latest start.
    """
    rows: dict[int, list[tuple[int, int, int]]] = {}
    out = []
    for i in sorted(found):
        b = bisect_left(barred, i)
        low = max(i - gap - 1, barred[b - 1] if b else 0)
        before = [x for k in range(low, i) for x in rows.get(k, ())]
        rows[i] = row = []
        for j in found[i]:
            m = bisect_left(marks, j)
            held = marks[m - 1] if m else -1  # the mark that must not be skipped
            n, a = max([(n, a) for at, n, a in before if held <= at < j], default=(0, i))
            if n or held < 0:
                row.append((j, n + 1, a))
                if not marks or j >= marks[-1]:
                    out.append((n + 1, a, i + 1))
    return out


def chains(words: list[str], runs: list[tuple[int, int, int]], built: Built, gap: int = MAX_GAP,
           cover: float = MIN_COVER) -> list[tuple[int, int, int, float]]:
    """(template, start, stop, coverage) of chains that cover enough of a template.

    Those of one template do not overlap; the one that covers most is taken first.
    """
    done = []
    for t, found in pairs(runs, built.machine, built.shortest).items():
        size = built.sizes[t]
        if len(found) / size < cover:
            continue
        barred = [i for i, w in enumerate(words) if w in built.tells[t]] if built.tells[t] else []
        ends = [x for x in chained(found, built.marks[t], barred, gap) if x[0] / size >= cover]
        taken: list[tuple[int, int]] = []
        for n, a, z in sorted(ends, key=lambda x: (-x[0], x[2], -x[1])):
            k = bisect(taken, (a, z))
            if (not k or taken[k - 1][1] <= a) and (k == len(taken) or z <= taken[k][0]):
                taken.insert(k, (a, z))
                done.append((t, a, z, n / size))
    return done


def telling(texts: list[list[str]], labels: list[str], alike: int = ALIKE) -> list[set[str]]:
    """Per template, the words by which it differs from templates of other labels that read much the same."""
    out = []
    for text, label in zip(texts, labels):
        own, tells = Counter(text), set()
        for other, name in zip(texts, labels):
            differ = (own - Counter(other)) + (Counter(other) - own)
            if name != label and differ.total() <= alike:
                tells |= set(differ)
        out.append(tells)
    return out


@dataclass(frozen=True)
class Built:
    """The automaton, and per template its label, length, telling words and the places a chain must hold."""

    machine: Automaton
    labels: list[str]
    base: list[str]
    sizes: list[int]
    shortest: list[int]
    tells: list[set[str]]
    marks: list[list[int]]


def build(templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> Built:
    texts, labels = [words_of(t) for _, t in templates], [label for label, _ in templates]
    machine, tells = Automaton(texts, [words_of(p) for p in base]), telling(texts, labels)
    marks = [[i for i, w in enumerate(text) if w in own or w in NAMING] for text, own in zip(texts, tells)]
    return Built(machine, labels, list(base.values()), [len(t) for t in texts], machine.shortest(), tells, marks)


def scan_text(text: str | None, built: Built) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    words, names = words_of(text), built.labels
    found, runs = built.machine.scan(words)
    spans = chains(words, runs, built)
    base = {built.base[p] for _, p in found}
    starts = [a for a, _ in found]
    score = 1.0 if found else max((c for *_, c in spans), default=0.0)
    listed = sorted([{"label": names[t], "start": a, "stop": z, "coverage": c} for t, a, z, c in spans],
                    key=lambda s: (s["start"], s["stop"], s["label"]))
    return (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {names[t] for t, *_ in spans})), score, listed)


def scanned(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``; see ``SCHEMA``.

    NULL and empty texts have no words, no labels and score 0; an empty table gives no
    rows and repeated rows each have one.  The score is 1 where a base phrase stands, else
    the best coverage of a template that labels.  Of overlapping chains of one template
    that cover the same, the one that ends first counts, then the shorter.
    """
    kind = dict(docs.dtypes)["doc_id"]
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()),
                                ("coverage", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = build()
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for b in batches:
            if len(b):
                columns = zip(*[scan_text(t, built) for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *[pa.array(list(c), t) for c, t in zip(columns, types)]], names)

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA.format(kind=kind))
