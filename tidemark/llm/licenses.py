"""License scan: a generalised suffix automaton over the words of licence notices.

The automaton holds every substring of every template. A document is streamed through it word by word, which gives
matching statistics (the longest template substring that ends at each word); long matches are placed in their
templates, and places that follow each other in one template are chained into covered spans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import documents

# Phrases and labels given for the scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Wording of public licence notices, as their publishers give it.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "released under the mit license",
    ],
    "apache": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version",
        "this work is licensed under the gnu general public license version 3",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ],
    "cc-by": [
        "this work is licensed under a creative commons attribution 4 0 international license",
        "licensed under cc by 4 0",
    ],
    "cc-by-nc": [
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        "licensed under cc by nc 4 0",
    ],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation either version 2 1 of the license or at "
        "your option any later version",
    ],
    "agpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero "
        "general public license as published by the free software foundation either version 3 of the license or at "
        "your option any later version",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
        "use compile sell or distribute this software either in source code form or as a compiled binary for any "
        "purpose commercial or non commercial and by any means",
    ],
    "cc0": [
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to "
        "this work",
    ],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license "
        "2 0 which is available at https www eclipse org legal epl 2 0",
    ],
}
#: A match is long from so many words; a chain may skip so many words; a template is present from this covered share.
LONG, GAP, COVERED = 3, 4, 0.8

_SEP = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_TABLE = bytes.maketrans(_SEP, b" " * len(_SEP))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.lower().translate(_TABLE).split()


@dataclass
class Automaton:
    """Suffix automaton of several word sequences."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: state -> (template, position past its end) of one or more occurrences
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length, step, link):
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, p, q, token):
        """A copy of q for the shorter strings that p extends by ``token``."""
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], template: int) -> None:
        last = 0
        for i, token in enumerate(sequence):
            p = last
            if token in self.step[p]:                # known from an earlier template
                q = self.step[p][token]
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
            else:
                last = self._state(self.length[p] + 1, {}, 0)
                while p >= 0 and token not in self.step[p]:
                    self.step[p][token] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.step[p][token]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
            self.ends[last].append((template, i + 1))

    def close(self) -> None:
        """Hand every occurrence on to the suffixes that share it."""
        for s in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]
        self.ends = [sorted(set(e)) for e in self.ends]

    def stream(self, tokens):
        """Matching statistics: (state, length) after every token."""
        state, n = 0, 0
        step, link, length = self.step, self.link, self.length
        for t in tokens:
            while state and t not in step[state]:
                state = link[state]
                n = length[state]
            if t in step[state]:
                state, n = step[state][t], n + 1
            else:
                state, n = 0, 0
            yield state, n


class Scanner:
    """Finds the phrases and the covered template spans of a text."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES):
        self.vocabulary: dict[bytes, int] = {}
        self.automaton, self.sizes, self.labels = Automaton(), [], []
        self.n_phrases = len(phrases)
        for label, text in [*((v, k) for k, v in phrases.items()),
                            *((label, t) for label, ts in templates.items() for t in ts)]:
            sequence = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text.encode())]
            self.automaton.add(sequence, len(self.sizes))
            self.sizes.append(len(sequence))
            self.labels.append(label)
        self.automaton.close()
        # state -> phrases that are a suffix of what it stands for, given a match at least as long as the phrase
        auto = self.automaton
        home: dict[int, list[int]] = {}
        for t, phrase in enumerate(phrases):
            *_, (state, _) = auto.stream([self.vocabulary[w] for w in words(phrase.encode())])
            home.setdefault(state, []).append(t)
        self.phrase_ends = [[] for _ in auto.step]
        for s in sorted(range(1, len(auto.step)), key=lambda s: auto.length[s]):
            self.phrase_ends[s] = self.phrase_ends[auto.link[s]] + home.get(s, [])

    def __call__(self, text: bytes) -> tuple:
        """(n_words, base places [(start, label)], spans [(label, first word, past last word, covered share)])."""
        own = words(text)
        get = self.vocabulary.get
        known = [(i, t) for i, t in enumerate(map(get, own)) if t is not None]
        base, spans, a = [], [], 0
        while a < len(known):
            z = a + 1
            while z < len(known) and known[z][0] == known[z - 1][0] + 1:
                z += 1
            if z - a > 1:
                self._run(known[a][0], [t for _, t in known[a:z]], base, spans)
            a = z
        return len(own), base, self._chain(spans)

    def _run(self, first: int, tokens: list[int], base: list, spans: list) -> None:
        found = list(self.automaton.stream(tokens))
        for i, (state, n) in enumerate(found):
            end = first + i + 1
            for t in self.phrase_ends[state]:
                if n >= self.sizes[t]:
                    base.append((end - self.sizes[t], self.labels[t]))
            # the match is maximal: the next word does not extend it
            if n >= LONG and (i + 1 == len(found) or found[i + 1][1] != n + 1):
                spans += [(t, at - n, end - n, n) for t, at in self.automaton.ends[state] if t >= self.n_phrases]

    def _chain(self, matches: list) -> list:
        """Matches of one template chained while both the text and the template move on, each chain the one that covers
        most words of the template.

        A match that overlaps its predecessor, in the text or in the template, counts from where both have moved on. A
        match in a better chain is not used again."""
        by_template: dict[int, list] = {}
        for t, at, place, n in matches:
            by_template.setdefault(t, []).append((place + n, at + n, n))
        out = []
        for t, own in by_template.items():
            own.sort()                                   # by end in the text; starts ascend with the ends
            best, before = [], []
            low = 0
            for k, (end, at_end, n) in enumerate(own):
                while own[low][0] < end - n - GAP:
                    low += 1
                most, pred = n, None
                for j in range(low, k):
                    skip = max(0, own[j][0] - (end - n), own[j][1] - (at_end - n))
                    if (skip < n and end - n + skip - own[j][0] <= GAP and at_end - n + skip - own[j][1] <= GAP
                            and best[j] + n - skip > most):
                        most, pred = best[j] + n - skip, j
                best.append(most)
                before.append(pred)
            used = [False] * len(own)
            for k in sorted(range(len(own)), key=lambda k: (-best[k], k)):
                j = k
                while j is not None and not used[j]:
                    used[j], first, j = True, j, before[j]
                    if j is None or used[j]:
                        covered = best[k] - (best[j] if j is not None else 0)
                        start = own[first][0] - (best[first] - (best[j] if j is not None else 0))
                        out.append((self.labels[t], start, own[k][0], covered / self.sizes[t]))
        return sorted(out, key=lambda s: (s[1], s[2], s[0], -s[3]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base (places of the given phrases), first_word, last_word (their
    smallest and largest start), base_labels, labels (also of templates covered by ``COVERED`` or more), score (1 if a
    phrase stands in the text, else the largest covered share of a template), spans (label, first word, past last
    word, covered share) of the chained matches.

    Null and empty texts have no words: counts 0, empty labels, score 0, null places. A null doc_id and repeated rows are
    scanned like any other row. An empty table gives no rows."""
    def run(batches):
        scan = Scanner()
        for b in batches:
            out = []
            for t in b.column(1).cast(pa.binary()):
                n, base, spans = scan(t.as_py())
                own = sorted({label for _, label in base})
                more = sorted({*own, *(s[0] for s in spans if s[3] >= COVERED)})
                starts = [s for s, _ in base]
                out.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(own),
                            ",".join(more), 1.0 if base else min(1.0, max((s[3] for s in spans), default=0.0)),
                            [dict(zip(("label", "first", "past", "covered"), s)) for s in spans]))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
                [("label", pa.string()), ("first", pa.int64()), ("past", pa.int64()), ("covered", pa.float64())]))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return documents(docs).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
             "labels string, score double, spans array<struct<label: string, first: long, past: long, covered: double>>")
