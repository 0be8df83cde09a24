"""Licence scan: matching statistics of a generalised suffix automaton, chained into template spans.

The automaton is built once, on the driver, from the words of all templates (some
thousand; their number is a parameter, not a matter of the corpus) and sent out. A
text is streamed through it: after each word it says how long a stretch of words
up to there some template has. Stretches that can't be lengthened, of at least
``least_match`` words, are placed in their templates, and places that follow one
another in text and template with at most ``most_gap`` words between are chained.
A chain that covers at least ``least_cover`` of its template is a span of it.

Phrases are templates that must be met whole; each place of one counts, and they
are found in the same pass: a phrase ends at a word if it is the end of the
stretch there. Words are the runs of digits, letters and characters beyond ASCII
after lower-casing A-Z, numbered from 0.

A null text is empty and has no spans. Texts are taken whole, in slices of some
megabytes at a time; equal rows give equal results; an empty table gives no rows;
only the two columns named are read, whatever others are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .licence_texts import NOTICES, PHRASES, TEXTS

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LEAST_MATCH, MOST_GAP, LEAST_COVER = 4, 12, 0.75
SLICE_BYTES = 4_000_000


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def slices(text: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """Stretches of a text that cut no word."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and WORD.match(text[end - 1 : end].lower()) and WORD.match(text[end : end + 1].lower()):
            end += 1
        yield text[at:end]
        at = end


class Automaton:
    """The suffix automaton of several word sequences: ``step`` from state 0, which is no words."""

    def __init__(self, sequences: list[list[bytes]]):
        self.words: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: dict[int, list[tuple[int, int]]] = {}  # of whole prefixes: the templates and places where they end
        for t, sequence in enumerate(sequences):
            state = 0
            for k, w in enumerate(sequence):
                state = self._extended(state, self.words.setdefault(w, len(self.words)))
                self.ends.setdefault(state, []).append((t, k + 1))
        self.below: list[list[int]] = [[] for _ in self.go]
        for state, up in enumerate(self.link):
            if up >= 0:
                self.below[up].append(state)
        self._places: dict[int, list[tuple[int, int]]] = {}

    def _state(self, go: dict[int, int], link: int, length: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        return len(self.go) - 1

    def _extended(self, last: int, w: int) -> int:
        if w in self.go[last]:
            return self._own(last, w)
        new, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and w not in self.go[p]:
            self.go[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._own(p, w)
        return new

    def _own(self, p: int, w: int) -> int:
        """The state of just the words of p and w: the one that p leads to, or a copy of it for the shorter words."""
        q = self.go[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.go[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = copy
            p = self.link[p]
        return copy

    def places(self, state: int) -> list[tuple[int, int]]:
        """(template, end) of every place of the words of a state."""
        if state not in self._places:
            found, open_ = [], [state]
            while open_:
                s = open_.pop()
                found += self.ends.get(s, [])
                open_ += self.below[s]
            self._places[state] = sorted(found)
        return self._places[state]

    def state_of(self, sequence: list[bytes]) -> int:
        state = 0
        for w in sequence:
            state = self.go[state][self.words[w]]
        return state

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """State and length of the longest stretch that ends with word ``w``."""
        go, link = self.go, self.link
        while state and w not in go[state]:
            state = link[state]
            length = self.length[state]
        state = go[state].get(w, 0)
        return state, length + 1 if state else 0


class Scanner:
    """Templates and phrases, ready to scan texts."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], least_match: int = LEAST_MATCH, most_gap: int = MOST_GAP, least_cover: float = LEAST_COVER):
        self.least_match, self.most_gap, self.least_cover = least_match, most_gap, least_cover
        self.templates = [(label, words_of(t.encode())) for label, t in templates]
        self.phrases = [(label, words_of(t.encode())) for label, t in phrases]
        self.automaton = a = Automaton([w for _, w in self.templates] + [w for _, w in self.phrases])
        #: By state the phrases that are the end of its words, the longest first.
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for k, (_, sequence) in enumerate(self.phrases):
            open_ = [a.state_of(sequence)] if sequence else []
            while open_:
                s = open_.pop()
                self.whole.setdefault(s, []).append((len(sequence), k))
                open_ += a.below[s]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """(words, places of phrases as (start, phrase), spans of templates as (template, start, end, words covered))."""
        a, whole, least = self.automaton, self.whole, self.least_match
        n, state, length = 0, 0, 0
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # end, length, state
        for part in slices(text):
            words = words_of(part)
            known = np.fromiter(map(a.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            at = np.flatnonzero(known >= 0)
            for i, w in zip(at.tolist(), known[at].tolist(), strict=True):
                i += n
                if i != last + 1 if length else False:
                    if length >= least:
                        matches.append((last + 1, length, state))
                    state = length = 0
                before, was = state, length
                state, length = a.step(state, length, w)
                if length <= was and was >= least:
                    matches.append((i, was, before))
                last = i
                for m, k in whole.get(state, ()):
                    if m <= length:
                        places.append((i + 1 - m, k))
            n += len(words)
        if length >= least:
            matches.append((last + 1, length, state))
        return n, sorted(places), self.chained(matches)

    def chained(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Spans of templates from the longest stretches, in order of their ends."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in matches:
            for t, k in self.automaton.places(state):
                if t < len(self.templates):
                    by_template.setdefault(t, []).append((end, k, length))
        out = []
        for t, found in sorted(by_template.items()):
            size = len(self.templates[t][1])
            best: list[tuple[int, int]] = []  # words covered by the best chain up to each, and the one before it
            for j, (end, k, length) in enumerate(found):
                top = (length, -1)
                for i in range(j - 1, -1, -1):
                    end_i, k_i, _ = found[i]
                    if end_i < end - length - self.most_gap:
                        break
                    if end_i < end and k_i < k and k - length - k_i <= self.most_gap:
                        top = max(top, (best[i][0] + min(length, end - end_i, k - k_i), i))
                best.append(top)
            taken: set[int] = set()
            for j in sorted(range(len(found)), key=lambda j: (-best[j][0], j)):
                if best[j][0] < self.least_cover * size:
                    break
                chain, i = [], j
                while i >= 0 and i not in taken:
                    chain.append(i)
                    i = best[i][1]
                if i < 0:  # else it is part of a better one
                    taken.update(chain)
                    out.append((t, found[chain[-1]][0] - found[chain[-1]][2], found[j][0], best[j][0]))
                else:
                    taken.update(chain)
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))


SPAN = "struct<label: string, template: int, start: long, end: long, covered: double>"
SCHEMA = f"doc_id long, n_words long, places array<struct<label: string, start: long>>, spans array<{SPAN}>"
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))


def find(docs: DataFrame, scanner: Scanner | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document; columns as in ``SCHEMA``: places of phrases and spans of templates, in words, the end exclusive. No shuffle."""
    common.small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(scanner or Scanner([*NOTICES, *TEXTS], list(PHRASES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shipped.value
        for batch in batches:
            rows = [s.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([[{"label": s.phrases[k][0], "start": at} for at, k in places] for _, places, _ in rows], _PLACES),
                    pa.array([[{"label": s.templates[t][0], "template": t, "start": at, "end": to, "covered": min(1.0, n / len(s.templates[t][1]))} for t, at, to, n in spans] for _, _, spans in rows], _SPANS),
                ],
                names=["doc_id", "n_words", "places", "spans"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_bytes(text).alias("text")).mapInArrow(run, SCHEMA)


def _labels(column: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(column)), ",")


def digest(found: DataFrame) -> DataFrame:
    """A row per document of ``find``: places of phrases counted, labels, and as ``score`` the largest share of a template that a span covers (a phrase's place covers it whole)."""
    starts, base, own = F.col("places.start"), F.col("places.label"), F.col("spans.label")
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.covered"), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.concat(base, own)).alias("labels"), score.alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )
