"""License scans: matching statistics from a generalised suffix automaton of licence texts, chained into spans.

The automaton holds the words of whole licences (the files in ``licenses``), of ``NOTICES`` and of ``PHRASES``.
Streaming a text's words through it gives, at each word, the longest suffix that occurs in some template; templates that
have only a shorter suffix stand on the way up its suffix links, so every template has a matching statistic of its own. A
stretch is a maximal such match of ``MIN_MATCH`` words or more, or of a shorter template's whole length. Stretches are chained: one
follows another of its template if, once what they share in the text is cut off its start, it begins at most
``MAX_GAP`` words behind the other in the text and in the template. A template's coverage is the share of its words in
the chain that covers most (of equal ones the first, then the shortest); its label is given from ``COVER`` on. The
score is the largest such coverage, or 1 where a phrase stands whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ALNUM, text_bytes
from folio.llm.suffix_automaton import SuffixAutomaton

MIN_MATCH, MAX_GAP, COVER = 4, 3, 0.8
#: Phrases that name a licence.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices by which texts state their licence.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("all-rights-reserved", "All rights reserved."),
]
#: Whole licences by file name, and the labels that they give.
LICENSES = {"Apache-2.0": "apache", "BSD-3-Clause": "bsd", "CC0-1.0": "cc0", "GPL-2": "gpl", "GPL-3": "gpl", "ISC": "isc", "LGPL-2.1": "lgpl", "MIT": "mit", "MPL-2.0": "mpl"}
SPAN = "array<struct<label:string,start:int,end:int,coverage:double>>"


@lru_cache(maxsize=1)
def templates() -> tuple[tuple[str, str], ...]:
    """(label, text) of every notice and every whole licence; the files are read on the driver and go with the tasks."""
    folder = Path(__file__).parent / "licenses"
    return (*NOTICES, *((label, (folder / f"{name}.txt").read_text()) for name, label in LICENSES.items()))


class LicenseMatcher:
    def __init__(self, templates, phrases=PHRASES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, cover: float = COVER) -> None:
        split = lambda text: text.encode().translate(ALNUM).split()
        self.templates = [(label, split(text)) for label, text in templates]
        self.phrases = [(label, split(text)) for text, label in phrases.items()]
        self.max_gap, self.cover = max_gap, cover
        self.sam = sam = SuffixAutomaton([w for _, w in self.templates] + [w for _, w in self.phrases])
        self.need = [min(min_match, len(w)) for _, w in self.templates]
        self.least, self.shortest = min(self.need, default=min_match), min((len(w) for _, w in self.phrases), default=min_match)
        size = len(sam.next)
        #: At a state: by template, the ends in it of every occurrence of the state's strings.
        self.places: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(size)]
        for t in range(len(self.templates)):
            for end, v in enumerate(sam.ends[t], 1):
                while v > 0:
                    self.places[v][t].append(end)
                    v = sam.link[v]
        #: At a state: its suffix links up to ``least`` words at which further templates begin to match, and these.
        self.further: list[list[tuple[int, list[int]]]] = [[] for _ in range(size)]
        for v in range(1, size):
            u, known = sam.link[v], len(self.places[v])
            while u > 0 and sam.length[u] >= self.least:
                if len(self.places[u]) > known:
                    known = len(self.places[u])
                    below = {t for _, ts in self.further[v] for t in ts}
                    self.further[v].append((u, [t for t in self.places[u] if t not in self.places[v] and t not in below]))
                u = sam.link[u]
        self.ending: list[list[tuple[int, str]]] = [[] for _ in range(size)]  # phrases that are suffixes of a state's strings
        own = defaultdict(list)
        for label, words in self.phrases:
            own[sam.find(words)].append((len(words), label))
        for v in sorted(range(1, size), key=sam.length.__getitem__):
            self.ending[v] = own[v] + self.ending[sam.link[v]]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """(start, label) of every phrase; (label, start, end, coverage) of the best chain of every template that reaches ``cover``."""
        sam, least, shortest = self.sam, self.least, self.shortest
        nxt, link, length = sam.next, sam.link, sam.length
        root = nxt[0]
        v = n = 0
        out, base = root, []
        stretches: list[tuple[int, int, int, int]] = []  # (end, length, state, template)
        now: dict[int, tuple[int, int]] = {}  # template: length and state of its match up to here
        for i, w in enumerate(words):
            to = out.get(w)
            if to is None:
                while v and to is None:
                    v = link[v]
                    to = nxt[v].get(w)
                if to is None:
                    v = n = 0
                    out = root
                else:
                    n = length[v]
            if to is not None:
                v, n = to, n + 1
                out = nxt[v]
            last, now = now, {}
            if n >= least:
                for t in self.places[v]:
                    now[t] = (n, v)
                for u, ts in self.further[v]:
                    for t in ts:
                        now[t] = (length[u], u)
            for t, (size, state) in last.items():
                if t not in now or now[t][0] != size + 1:
                    stretches.append((i, size, state, t))
            if n >= shortest and (ending := self.ending[v]):
                base += [(i + 1 - size, label) for size, label in ending if size <= n]
        stretches += [(len(words), size, state, t) for t, (size, state) in now.items()]
        return base, self._chain(stretches) if stretches else []

    def _chain(self, stretches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """The best chain of each template over its stretches in the order of the text; chains that no later stretch can follow are dropped."""
        open_: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # template: (words covered, -start, end, end in the template) of chains
        best: dict[int, tuple[int, int, int]] = {}  # template: words covered, -start, -end
        for end, n, v, t in stretches:
            if n < self.need[t]:
                continue
            start, new = end - n, []
            open_[t] = [c for c in open_[t] if start - c[2] <= self.max_gap]
            for at in self.places[v][t]:
                mine = (n, -start, end, at)
                for covered, begin, last, place in open_[t]:
                    shared = max(0, last - start)
                    if shared < n and 0 <= at - n + shared - place <= self.max_gap:
                        mine = max(mine, (covered + n - shared, begin, end, at))
                new.append(mine)
                best[t] = max(best.get(t, (0, 0, 0)), (mine[0], mine[1], -mine[2]))
            open_[t] += new
        spans = [(self.templates[t][0], -s, -e, c / len(self.templates[t][1])) for t, (c, s, e) in best.items()]
        return sorted(x for x in spans if x[3] >= self.cover)


_MATCHERS: dict[str, LicenseMatcher] = {}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given_templates=None, phrases=PHRASES) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``first_word`` and ``last_word`` are the smallest and largest start of a phrase, in words from 0, or null.
    Labels are distinct, sorted and joined by commas; ``labels`` holds the base labels and those of covered
    templates. Null or empty texts have no words, empty labels and score 0. Other columns are not read.
    """
    span_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    texts_of = templates() if given_templates is None else tuple(given_templates)
    key = sha256(repr((texts_of, phrases)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MATCHERS:  # one automaton for each worker process
            _MATCHERS.clear()
            _MATCHERS[key] = LicenseMatcher(texts_of, phrases)
        matcher = _MATCHERS[key]
        for ids, texts in text_bytes(batches, "id", "raw"):
            rows = []
            for raw in texts:
                words = raw.translate(ALNUM).split()
                base, spans = matcher.match(words)
                own = {label for _, label in base}
                starts = [at for at, _ in base]
                score = 1.0 if base else max((x[3] for x in spans), default=0.0)
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in spans})), score, [dict(zip(("label", "start", "end", "coverage"), x, strict=True)) for x in spans]))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), span_type]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return given.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPAN}").withColumnRenamed("id", id_col)
