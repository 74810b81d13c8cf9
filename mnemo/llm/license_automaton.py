"""License scans with a generalised suffix automaton over licence tokens.

The automaton is built once from the templates (phrases and short licence
passages, all as words) and shipped with the task closure: its size is set by
the templates alone.  A file is streamed through it: after each word, the
state and the matched length are the matching statistic, the longest suffix
of the words read so far that occurs in some template.  Only runs of words
from the templates' vocabulary reach the automaton; any other word resets the
statistic to zero, so the other words are skipped in numpy.

Two things are read off the statistics:

* base places: a phrase ends at a word if the phrase's state lies on the
  suffix-link path of the current state and is matched in full
* covered spans: maximal matches of at least `min_match` words are chained
  per template (gaps of at most `max_gap` words); a chain that covers at
  least `min_cover` of its template's words adds the template's label

Words are lower-cased in A-Z and split at other ASCII characters.  The score
is the largest share of a template that a file covers (1 for a base phrase).

Defined cases: null, empty and wordless texts have no words, places or
labels; one row is returned per input row.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .automaton import SuffixAutomaton
from .common import arrow_map, pick

# The phrases of the base search and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening or characteristic passages of public licence texts.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in "
                "compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
           "the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
           "public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 8, 0.6


def _word_ids(texts: list[str]) -> list[np.ndarray]:
    """Word ids of short texts (one chunk)."""
    out = []
    for w in W.tokenize(pa.array(texts), "alnum"):
        out += [w.ids[w.ptr[i]:w.ptr[i + 1]] for i in range(w.n)]
    return out


class LicenseIndex:
    """The automaton with, per state, the phrases that end there and where its string occurs in the templates."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.labels = list(phrases.values()) + list(templates)
        ids = _word_ids([*phrases, *templates.values()])
        self.n_phrases = len(phrases)
        self.sizes = [len(x) for x in ids]
        self.vocabulary = np.unique(np.concatenate(ids))
        sa = self.automaton = SuffixAutomaton()
        states = []
        for x in ids:
            sa.start()
            states.append([sa.extend(c) for c in x.tolist()])
        children = defaultdict(list)
        for v, p in enumerate(sa.link):
            if p >= 0:
                children[p].append(v)
        # end positions of every state's strings: its own and those of its descendants in the suffix-link tree
        self.ends: list[list[tuple[int, int]]] = [[] for _ in sa.link]
        for t, path in enumerate(states):
            sa.start()
            v = 0
            for i, c in enumerate(ids[t].tolist()):
                v = sa.next[v][c]
                self.ends[v].append((t, i))
        for v in sorted(range(1, len(sa.link)), key=lambda v: -sa.length[v]):
            if sa.link[v] > 0:
                self.ends[sa.link[v]] += self.ends[v]
        self.ends = [sorted(set(e)) for e in self.ends]
        # phrases that are a suffix of a state's strings
        at = defaultdict(list)
        for t in range(self.n_phrases):
            v = 0
            for c in ids[t].tolist():
                v = sa.next[v][c]
            at[v].append(t)
        self.phrase_ends: list[list[int]] = [[] for _ in sa.link]
        stack = [0]
        while stack:
            v = stack.pop()
            self.phrase_ends[v] = (self.phrase_ends[sa.link[v]] if v else []) + at[v]
            stack += children[v]

    def scan(self, run: list[int]):
        """Base places [(phrase, first word)] and maximal matches [(last word, length, state)] of a run of words."""
        places, matches, before = [], [], None
        for i, (v, n) in enumerate(self.automaton.stream(run)):
            for t in self.phrase_ends[v]:
                if self.sizes[t] <= n:
                    places.append((t, i - self.sizes[t] + 1))
            if before and n <= before[1]:
                matches.append(before)
            before = (i, n, v)
        if before:
            matches.append(before)
        return places, [m for m in matches if m[1] >= MIN_MATCH]

    def chains(self, matches: list[tuple[int, int, int]]) -> dict[int, float]:
        """Covered share of each template by its best chain of matches (end, length, state) in word order."""
        open_chains: dict[int, list] = {}
        best: dict[int, float] = {}
        for end, n, v in matches:
            for t, at in self.ends[v]:
                if t < self.n_phrases:
                    continue
                c = open_chains.get(t)
                if c is None or end - n + 1 - c[0] > MAX_GAP + 1 or at <= c[1]:
                    c = open_chains[t] = [end, at, min(n, at + 1)]
                else:
                    c[2] += min(n, at - c[1], end - c[0])
                    c[0], c[1] = end, at
                best[t] = max(best.get(t, 0.0), min(1.0, c[2] / self.sizes[t]))
        return best


def _scan(index: LicenseIndex, shortest: int):
    def run(batches):
        known = index.vocabulary
        for b in batches:
            names = b.column("doc_id")
            for w in W.tokenize(b.column("text"), "alnum"):
                at = np.minimum(np.searchsorted(known, w.ids), len(known) - 1)
                inside = known[at] == w.ids
                edge = np.ones(len(inside), bool)
                edge[1:] = inside[1:] != inside[:-1]
                firsts = w.ptr[:-1][w.ptr[:-1] < len(inside)]
                edge[firsts] = True
                starts = np.flatnonzero(edge)
                sizes = np.diff(np.append(starts, len(inside)))
                pick_ = inside[starts] & (sizes >= shortest)
                starts, sizes = starts[pick_], sizes[pick_]
                text = np.searchsorted(w.ptr, starts, side="right") - 1
                found: dict[int, tuple[list, list]] = {}
                for d, s, n in zip(text.tolist(), starts.tolist(), sizes.tolist()):
                    places, matches = index.scan(w.ids[s:s + n].tolist())
                    if places or matches:
                        p, m = found.setdefault(d, ([], []))
                        s -= int(w.ptr[d])
                        p += [(t, s + i) for t, i in places]
                        m += [(s + i, k, v) for i, k, v in matches]
                n_base, first, last = np.zeros(w.n, np.int64), [None] * w.n, [None] * w.n
                base, labels, score = [""] * w.n, [""] * w.n, np.zeros(w.n)
                spans = [[] for _ in range(w.n)]
                for d, (p, m) in found.items():
                    cover = index.chains(m)
                    own = {index.labels[t] for t, _ in p}
                    more = {index.labels[t] for t, c in cover.items() if c >= MIN_COVER}
                    n_base[d] = len(p)
                    if p:
                        first[d], last[d] = min(i for _, i in p), max(i for _, i in p)
                    base[d], labels[d] = ",".join(sorted(own)), ",".join(sorted(own | more))
                    score[d] = 1.0 if p else max(cover.values(), default=0.0)
                    spans[d] = [{"start": e - k + 1, "end": e + 1} for e, k, _ in m]
                yield {"doc_id": names.slice(w.first, w.n), "n_words": np.diff(w.ptr), "n_base": n_base,
                       "first_word": pa.array(first, pa.int64()), "last_word": pa.array(last, pa.int64()),
                       "base_labels": pa.array(base), "labels": pa.array(labels), "score": score, "matches": spans}
    return run


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", phrases: dict[str, str] = PHRASES,
                  templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (template spans in words)."""
    index = LicenseIndex(phrases, templates)
    d = pick(docs, doc_id=doc_id, text=text)
    kind = d.schema["doc_id"].dataType.simpleString()
    shortest = min(MIN_MATCH, *index.sizes[:index.n_phrases])
    return arrow_map(d, _scan(index, shortest),
                     f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                     "labels string, score double, matches array<struct<start:bigint,end:bigint>>")
