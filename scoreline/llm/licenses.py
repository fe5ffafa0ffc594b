"""Licence scan: matching statistics against a generalised suffix automaton of templates.

The automaton holds every run of words of every licence template (a few hundred words
altogether, so it is built once and travels with the task).  A text streams through it:
after each word, the state is the longest run of template words that ends there.  Base
phrases are templates too, so a phrase stands at a place when the current run is at
least as long and its state lies below the phrase's state in the suffix-link tree.  Runs
that cannot be extended are maximal matches; matches that go on in the same template (in
order, with few words between) are chained into a span, and the share of the template's
words that the span covers is its score.  Words that tell look-alikes apart (``MARKS``) must
match, and none that the template lacks may stand between chained matches.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm import words as wd

# fixed values: base phrases and their labels
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
           "mit license": "mit"}

# licence notices: label -> text
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 you may not use this file except "
                  "in compliance with the license",
    "gpl-3.0": "this program is free software you can redistribute it and or modify it under the "
               "terms of the gnu general public license as published by the free software "
               "foundation either version 3 of the license or any later version",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of "
                "this software and associated documentation files the software to deal in the "
                "software without restriction",
    "bsd": "redistribution and use in source and binary forms with or without modification are "
           "permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-4.0": "licensed under cc by 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-creative-commons": "this work is licensed under a creative commons attribution 4 0 "
                              "international license",
    "all-rights-reserved": "all rights reserved",
    "gpl-2.0": "this program is free software you can redistribute it and or modify it under the "
               "terms of the gnu general public license as published by the free software "
               "foundation either version 2 of the license or any later version",
    "lgpl-2.0": "is free software you can redistribute it and or modify it under the terms of the "
                "gnu library general public license as published by the free software foundation "
                "either version 2 of the license or any later version",
    "lgpl-2.1": "is free software you can redistribute it and or modify it under the terms of the "
                "gnu lesser general public license as published by the free software foundation "
                "either version 2 1 of the license or any later version",
    "lgpl-3.0": "is free software you can redistribute it and or modify it under the terms of the "
                "gnu lesser general public license as published by the free software foundation "
                "either version 3 of the license or any later version",
    "agpl-3.0": "is free software you can redistribute it and or modify it under the terms of the "
                "gnu affero general public license as published by the free software foundation "
                "either version 3 of the license or any later version",
    "bsd-2-clause": "licensed under the bsd 2 clause license",
    "bsd-3-clause": "licensed under the bsd 3 clause license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or "
           "without fee is hereby granted provided that the above copyright notice and this "
           "permission notice appear in all copies",
    "cc-by-nd-4.0": "licensed under cc by nd 4 0",
    "cc-by-nc-sa-4.0": "licensed under cc by nc sa 4 0",
    "cc-by-nc-nd-4.0": "licensed under cc by nc nd 4 0",
    **{f"cc-by-{short}-creative-commons": "this work is licensed under a creative commons "
       f"attribution {long} 4 0 international license" for short, long in (
           ("sa", "sharealike"), ("nc", "noncommercial"), ("nd", "noderivatives"),
           ("nc-sa", "noncommercial sharealike"), ("nc-nd", "noncommercial noderivatives"))},
}
# words that tell one licence of a family from another
MARKS = ("lesser library affero sa nc nd sharealike alike noncommercial commercial noderivatives "
         "noderivs derivatives derivs 0 1 2 3 4 5 6 7 8 9")
MIN_MATCH = 2        # words of a match that counts for a span
MAX_GAP = 6          # words of text or template between chained matches
MIN_COVER = 0.8      # covered share of a template for its label


class Automaton:
    """Generalised suffix automaton over word ids (0 .. n_words - 1)."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: one place (template, end) of each state's runs
        self.place: list[tuple[int, int]] = [(-1, 0)]
        for t, text in enumerate(texts):
            last = 0
            for i, c in enumerate(text):
                last = self._extend(last, c, (t, i + 1))

    def _state(self, length: int, edges: dict[int, int], link: int, place: tuple[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.place.append(place)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of ``q`` for the shorter runs that arrive from ``p`` by ``c``."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.place[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int, place: tuple[int, int]) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1, {}, 0, place)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def find(self, run: list[int]) -> int:
        """State of a run of words that occurs in the templates."""
        s = 0
        for c in run:
            s = self.next[s][c]
        return s

    def below(self, top: int) -> set[int]:
        """States whose runs end with the shortest run of ``top``."""
        out = set()
        for s in range(len(self.next)):
            t = s
            while t not in (-1, top):
                t = self.link[t]
            if t == top:
                out.add(s)
        return out


class Scanner:
    """Templates as an automaton, with word ids by hash."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str],
                 min_match: int, max_gap: int, min_cover: float):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.labels = list(templates)
        texts = [wd.word_hash(t, wd.ALNUM, lower=True) for t in [*templates.values(), *phrases]]
        marks = wd.word_hash(MARKS, wd.ALNUM, lower=True)
        self.vocab = np.unique(np.concatenate([*texts, marks]))
        ids = [np.searchsorted(self.vocab, t).tolist() for t in texts]
        self.sizes = [len(t) for t in ids]
        marks = set(np.searchsorted(self.vocab, marks).tolist())
        #: per template: its marks up to each place, and the marks that it lacks
        self.marked = [np.append(0, np.cumsum([c in marks for c in t])).tolist()
                       for t in ids[:len(templates)]]
        self.foreign = [marks - set(t) if m[-1] else set() for t, m in zip(ids, self.marked)]
        self.sam = Automaton(ids)
        pairs = {(a, b) for t in ids for a, b in zip(t, t[1:])}
        n = len(self.vocab)
        self.pair = np.zeros((n + 1, n + 1), dtype=bool)
        for a, b in pairs:
            self.pair[a, b] = True
        #: which words may be looked up, by 16 bits of the hash
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.vocab >> np.uint64(48)).astype(np.int64)] = True
        #: state -> phrases that its runs end with (label, words)
        self.ends: dict[int, list[tuple[str, int]]] = {}
        for (phrase, label), run in zip(phrases.items(), ids[len(templates):]):
            for s in self.sam.below(self.sam.find(run)):
                self.ends.setdefault(s, []).append((label, len(run)))

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each word; the number of ids for words of no template."""
        n = len(self.vocab)
        out = np.full(len(hashes), n, dtype=np.int64)
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        if n and len(at):
            k = np.searchsorted(self.vocab, hashes[at])
            k[k == n] = 0
            ok = self.vocab[k] == hashes[at]
            out[at[ok]] = k[ok]
        return out

    def stream(self, run: list[int], at: int, base: list, matches: list) -> None:
        """Matching statistics of one stretch of template words that starts at word ``at``:
        phrase places go to ``base``, maximal matches (text, template, place, words)."""
        sam, state, n = self.sam, 0, 0
        for i, c in enumerate([*run, -1]):
            if c not in sam.next[state]:
                if n >= self.min_match:
                    t, end = sam.place[state]
                    matches.append((at + i - n, t, end - n, n))
                while state and c not in sam.next[state]:
                    state = sam.link[state]
                    n = sam.length[state]
                if c not in sam.next[state]:
                    n = 0
                    continue
            state, n = sam.next[state][c], n + 1
            for label, size in self.ends.get(state, ()):
                if size <= n:
                    base.append((at + i - size + 1, label))

    def chain(self, ids: np.ndarray, matches: list) -> list[tuple[str, int, int, float]]:
        """Template spans (label, first word, last word, covered share) of one document.

        A match names one place of its run of words; as the same run may stand in several
        templates, each is looked up for every template that holds it."""
        out = []
        for t, label in enumerate(self.labels):
            longest: dict[tuple[int, int], int] = {}    # a match may cut another's piece short
            for at, _, _, n in matches:
                for k, m in self._in(t, tuple(ids[at:at + n].tolist())):
                    key = (at + k[0], k[1])
                    longest[key] = max(m, longest.get(key, 0))
            marked, foreign = self.marked[t], self.foreign[t]
            # [text end, template end, covered, first word, marks covered]
            chains: list[list[int]] = []
            for (at, place), n in sorted(longest.items()):
                best = None
                for c in chains:
                    if 0 <= at - c[0] <= self.max_gap and 0 <= place - c[1] <= self.max_gap and (
                            best is None or c[2] > best[2]) and (
                            not foreign or foreign.isdisjoint(ids[c[0]:at].tolist())):
                        best = c
                seen = marked[place + n] - marked[place]
                if best is not None:
                    best[0], best[1], best[2] = at + n, place + n, best[2] + n
                    best[4] += seen
                else:
                    chains.append([at + n, place + n, n, at, seen])
                if len(chains) > 64:        # chains that no later match can reach are settled
                    out += self._settle(label, t, [c for c in chains if at - c[0] > self.max_gap])
                    chains = [c for c in chains if at - c[0] <= self.max_gap]
            out += self._settle(label, t, chains)
        # of overlapping spans, the one that covers most words (then the shortest) stays
        out.sort(key=lambda s: (-s[3] * self.sizes[self.labels.index(s[0])], s[2] - s[1], s))
        kept: list[tuple[str, int, int, float]] = []
        taken: list[tuple[int, int]] = []
        for s in out:
            i = bisect.bisect_left(taken, (s[1], s[1]))
            if (i == 0 or taken[i - 1][1] < s[1]) and (i == len(taken) or taken[i][0] > s[2]):
                taken.insert(i, (s[1], s[2]))
                kept.append(s)
        return kept

    def _settle(self, label: str, t: int, chains: list[list[int]]) -> list[tuple]:
        return [(label, c[3], c[0] - 1, c[2] / self.sizes[t]) for c in chains
                if c[2] >= self.min_cover * self.sizes[t] and c[4] == self.marked[t][-1]]

    def _in(self, t: int, run: tuple[int, ...]) -> list[tuple[tuple[int, int], int]]:
        """Maximal pieces of ``run`` in template t: ((offset in run, place), words)."""
        key = (t, run)
        if key not in self._memo:
            if len(self._memo) > 100_000:
                self._memo.clear()
            text, out = self._texts[t], []
            for p in range(1 - len(run), len(text)):
                i = max(0, -p)
                while i < min(len(run), len(text) - p):
                    j = i
                    while j < min(len(run), len(text) - p) and run[j] == text[p + j]:
                        j += 1
                    if j - i >= self.min_match:
                        out.append(((i, p + i), j - i))
                    i = j + 1
            self._memo[key] = out
        return self._memo[key]

    def prepare(self, templates: dict[str, str]) -> "Scanner":
        self._texts = [np.searchsorted(self.vocab, wd.word_hash(t, wd.ALNUM, lower=True)).tolist()
                       for t in templates.values()]
        self._memo: dict = {}
        return self

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple]:
        """(words, places, first, last, base labels, labels, score, spans) per document."""
        w = wd.Words(buf, offs, wd.ALNUM, lower=True)
        ids = self.word_ids(w.hash)
        doc = w.doc()
        # stretches of words joined by template pairs inside a document
        linked = self.pair[ids[:-1], ids[1:]] & (doc[:-1] == doc[1:]) if len(ids) else \
            np.zeros(0, dtype=bool)
        edge = np.diff(np.concatenate([[0], linked.view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        got: dict[int, tuple[list, list]] = {}
        for a, b in zip(begin.tolist(), end.tolist()):
            d = int(doc[a])
            base, matches = got.setdefault(d, ([], []))
            self.stream(ids[a:b].tolist(), a, base, matches)
        out = []
        for d, (n, first) in enumerate(zip(w.counts.tolist(), w.first.tolist())):
            base, matches = got.get(d, ((), ()))
            spans = self.chain(ids, matches) if matches else []
            labels = {x for _, x in base}
            places = [p - first for p, _ in base]
            out.append((n, len(base), min(places, default=None), max(places, default=None),
                        ",".join(sorted(labels)),
                        ",".join(sorted(labels | {s[0] for s in spans})),
                        min(1.0, max([s[3] for s in spans] + [0.5 * bool(base)], default=0.0)),
                        [{"label": s[0], "first": s[1] - first, "last": s[2] - first,
                          "cover": min(1.0, s[3])} for s in sorted(spans, key=lambda s: s[1:])]))
        return out


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double, "
          "spans array<struct<label:string,first:long,last:long,cover:double>>")
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
                             ("cover", pa.float64())]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None,
         phrases: dict[str, str] | None = None, min_match: int = MIN_MATCH,
         max_gap: int = MAX_GAP, min_cover: float = MIN_COVER,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of every row of ``docs``: base phrase places, labels, score and spans.

    ``score`` is the best covered share of a template, at least 0.5 where a base phrase
    stands, 0 without licence.  Null and empty texts have no words (null places, empty
    labels).  One row per input row, repeated rows included; a null id stays null; an empty
    table gives an empty result; other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, min_match, max_gap, min_cover).prepare(templates)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), _SPANS]
        for batch in batches:
            for part, buf, offs in wd.blocks(batch):
                rows = scanner.scan(buf, offs)
                cols = [part.column(0).to_pylist(), *zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(cols, types)], names=names)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, SCHEMA)
