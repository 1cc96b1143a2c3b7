"""License scan: a generalised suffix automaton of licence tokens and chained matching statistics.

All templates (as word sequences; a label may have several) go into one suffix automaton. A document is streamed through it word by word, which
gives at each word the length of the longest run of words ending there that occurs in some template (its matching
statistics). Maximal runs of at least ``min_match`` words are chained, in the order of the template, with gaps of at
most ``max_gap`` words; a chain covers a span of the document and a share of the template. A template whose covered
share reaches ``min_cover`` labels the document.

The base phrases are looked up beside that: all places where a phrase's words stand consecutively.

score is 1 where a base phrase stands, else the largest covered share of a template (0 to 1).

Defined results: a null text is empty (no words, no labels, empty strings, null positions, score 0); ties between
chains go to the earlier one; repeated rows are scanned each; an empty table gives an empty result; a null doc_id stays; of
a very long text, its words are held beside it and only runs of template words are walked; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, binary_column, rows_of
from .licence_texts import TEMPLATES

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:int,end:int,cover:double>>"
)


class LicenceAutomaton:
    """Generalised suffix automaton over the word ids of the templates."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        texts = [(label, text) for label in sorted(templates) for text in templates[label]]
        self.labels = [label for label, _ in texts]
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        self.sizes = []
        for t, (_, text) in enumerate(texts):
            words = ascii_words(text.encode())
            self.sizes.append(len(words))
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                self.ends[last].append((t, at + 1))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]].extend(self.ends[state])
        self.ends = [sorted(set(e)) for e in self.ends]
        self.ends[0] = []

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another template has this run already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def matching_statistics(self, ids: list[int]) -> list[tuple[int, int]]:
        """For each word the state and length of the longest run ending there that occurs in a template."""
        out, state, size = [], 0, 0
        for word in ids:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            out.append((state, size))
        return out

    def runs(self, words: list[bytes], least: int) -> list[tuple[int, int, int, int]]:
        """(template, template start, document start, words) of maximal runs of at least ``least`` words."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int32)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0])))).reshape(-1, 2)
        found = []
        for a, b in edges[edges[:, 1] - edges[:, 0] >= least]:
            stats = self.matching_statistics(ids[a:b].tolist())
            for i, (state, size) in enumerate(stats):
                if size >= least and (i + 1 == len(stats) or stats[i + 1][1] <= size):
                    found += [(t, end - size, int(a) + i + 1 - size, size) for t, end in self.ends[state]]
        return found

    def chains(self, words: list[bytes], least: int, gap: int) -> list[tuple[str, int, int, float]]:
        """Best chain of each template: label, document start and end, covered share of the template."""
        by = defaultdict(list)
        for t, at, start, size in self.runs(words, least):
            by[t].append((start, at, size))
        out = []
        for t, runs in sorted(by.items()):
            best: list[tuple[int, int, int, int]] = []  # covered, document start, end, template end
            top = (0, 0, 0)
            for start, at, size in sorted(runs):
                covered, first = size, start
                best = [b for b in best if start - b[2] <= gap]  # starts only grow, so the others are out of reach for good
                for c, f, end, t_end in reversed(best):
                    new = size - max(0, end - start, t_end - at)
                    if at + size > t_end and new > 0 and at - t_end <= gap and c + new > covered:
                        covered, first = c + new, f
                best.append((covered, first, start + size, at + size))
                if covered > top[0]:
                    top = (covered, first, start + size)
            out.append((self.labels[t], top[1], top[2], min(1.0, top[0] / self.sizes[t])))
        return out


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> dict[str, list[int]]:
    """Starts, in words, of each phrase's places."""
    text, out = b" %b " % b" ".join(words), {}
    for phrase in phrases:
        key, at, seen, number = b" %b " % b" ".join(ascii_words(phrase.encode())), -1, 0, 0
        while (at := text.find(key, at + 1)) >= 0:
            number += text.count(b" ", seen, at)
            seen = at
            out.setdefault(phrase, []).append(number)
    return out


def scan_licences(
    docs: DataFrame,
    templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
    min_match: int = 5,
    max_gap: int = 12,
    min_cover: float = 0.3,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, the ``keep`` columns and the scan's columns for every document."""
    machine = LicenceAutomaton(TEMPLATES if templates is None else templates)
    phrases = PHRASES if phrases is None else phrases
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def one(text: bytes | None) -> tuple:
        words = ascii_words(text)
        places = phrase_places(words, phrases)
        starts = [x for p in places.values() for x in p]
        base = sorted({phrases[p] for p in places})
        chains = sent.value.chains(words, min_match, max_gap)
        best = {c[0]: c for c in sorted(chains, key=lambda c: c[3])}  # of a label's templates, the one covered best
        own = [c for _, c in sorted(best.items()) if c[3] >= min_cover]
        score = 1.0 if starts else max([0.0, *(c[3] for c in chains)])
        spans = [{"label": c[0], "start": c[1], "end": c[2], "cover": c[3]} for c in own]
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return len(words), len(starts), first, last, ",".join(base), ",".join(sorted({*base, *(c[0] for c in own)})), score, spans

    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cover", pa.float64())]))]
    names = re.findall(r"(\w+) (?:long|string|double|array)", SCHEMA)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 2000):
            out = [one(t) for t in binary_column(batch, "text")]
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", *keep)] + columns, ["doc_id", *keep, *names])

    kept = [docs.schema[c] for c in ("doc_id", *keep)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + SCHEMA
    return docs.select("doc_id", *keep, F.col("text")).mapInArrow(scan, schema)
