"""Benchmark decontamination with one Aho-Corasick automaton.

Every benchmark item is normalised to words (A-Z lower-cased, words of digits, letters and non-ASCII characters) and
cut into windows of ``window`` consecutive words; a shorter, non-empty item is one window. All windows of all items form
one automaton. A document is normalised the same way and scanned once; matches are mapped back to word numbers and to
character offsets of the original text.

Defined results: a null or wordless text has no words and no hits; an item without words has no windows; items with a
null id hit words but are not listed; repeated items count once by id; ties cannot occur; an empty benchmark hits
nothing; extra columns of either table are ignored, and the result has the id column and the columns named below; of a very
long text, its words are held beside it.

Words are numbered, and a number is two characters (of alphabets that have the square root of the vocabulary each, and
nothing in common), so the automaton has two states for a word of a window and none has more children than an alphabet.
Measured, it takes about 150 MB and 2 s for each MB of items, in every Python worker.

The items' total size is measured first. Up to ``max_bytes`` they are one automaton. Beyond, they are cut into parts of
about that size, and each part is a pass of its own over the documents, with the hits so far in a table of the shared
folder; so a worker and the driver hold one part at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, binary_column, discard, materialise, rows_of, shielded, unshielded

SCHEMA = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_READY: dict[str, "WindowAutomaton"] = {}


class WindowAutomaton:
    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        self.items = [i for i, _ in items]
        self.vocabulary: dict[bytes, str] = {}
        split = [ascii_words(text) for _, text in items]
        for words in split:
            self.vocabulary.update(zip(words, repeat("")))
        base = isqrt(len(self.vocabulary)) + 1
        for n, word in enumerate(self.vocabulary):
            self.vocabulary[word] = chr(1 + n // base) + chr(1 + base + n % base)
        self.sizes: list[int] = []
        self.owners: list[tuple[int, ...]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, words in enumerate(split):
            text = "".join(map(self.vocabulary.__getitem__, words))
            for i in range(max(1, len(words) - window + 1)) if words else ():
                key = text[2 * i : 2 * (i + window)]
                known = self.automaton.get(key, -1)
                if known < 0:
                    self.automaton.add_word(key, len(self.sizes))
                    self.sizes.append(len(key) // 2)
                    self.owners.append((n,))
                elif self.owners[known][-1] != n:
                    self.owners[known] += (n,)
        if self.sizes:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Flags of hit words (None if there are none) and the ids of items with occurring windows."""
        if not self.sizes or not words:
            return None, set()
        found = list(self.automaton.iter("".join(map(self.vocabulary.get, words, repeat("\0\0")))))
        if not found:
            return None, set()
        steps, ids = np.zeros(len(words) + 1, np.int64), set()
        for end, n in found:
            last = (end + 1) // 2
            steps[last - self.sizes[n]] += 1
            steps[last] -= 1
            ids.update(self.items[k] for k in self.owners[n])
        ids.discard(None)
        return np.cumsum(steps)[:-1] > 0, ids


def char_spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as [start, end) character offsets of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    spans, seen_b, seen_c = [], 0, 0
    for a, b in edges.reshape(-1, 2):
        lo = seen_c + len(text[seen_b : at[a][0]].decode("utf-8", "replace"))
        hi = lo + len(text[at[a][0] : at[b - 1][1]].decode("utf-8", "replace"))
        spans.append({"start": lo, "end": hi})
        seen_b, seen_c = at[b - 1][1], hi
    return spans


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = 4 << 20, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, the ``keep`` columns of ``docs``, and for each document n_words, n_hit, item_ids (sorted) and spans."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-int(total) // max_bytes))
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    kept = [docs.schema[c] for c in dict.fromkeys(("doc_id", *keep, "text"))]
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    rows = docs.select("doc_id", *keep, *([] if "text" in keep else ["text"]))
    for n in range(parts):
        sent = spark.sparkContext.broadcast([(r.item_id, r.text.encode()) for r in items.filter(slot == n).collect()])  # about max_bytes
        before = rows
        if n + 1 < parts:
            rows = materialise(rows.mapInArrow(_scanner(sent, window, [f.name for f in kept], False), f"{own}, _hit binary, _ids array<string>"), "hits")
            sent.destroy()
        else:
            out = [docs.schema[c] for c in ("doc_id", *keep)]
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", " + SCHEMA
            rows = rows.mapInArrow(_scanner(sent, window, [f.name for f in out], True), schema)
        if 0 < n < parts - 1:
            discard(before)
    return rows


def _scanner(sent, window: int, names: list[str], last: bool):
    """A pass over documents with one part of the items; _hit (a bit for each word) and _ids hold what was found before."""
    run = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if run not in _READY:
            _READY.clear()
            _READY[run] = WindowAutomaton(sent.value, window)
        machine = _READY[run]
        for batch in rows_of(batches, 2000):
            texts = binary_column(batch, "text")
            split = [ascii_words(t) for t in texts]
            hits: list[np.ndarray | None] = [None] * len(texts)
            ids: list[set[str]] = [set() for _ in texts]
            if "_hit" in batch.schema.names:
                known = batch.column("_hit").to_pylist()
                hits = [np.unpackbits(np.frombuffer(h, np.uint8), count=len(w)).astype(bool) if h else None for h, w in zip(known, split, strict=True)]
                ids = [set(x) for x in batch.column("_ids").to_pylist()]
            for i, words in enumerate(split):
                hit, found = machine.scan(words)
                if hit is not None:
                    hits[i] = hit if hits[i] is None else hits[i] | hit
                    ids[i] |= found
            columns = [batch.column(c) for c in names]
            if last:
                columns += [
                    pa.array([len(w) for w in split], pa.int64()),
                    pa.array([0 if h is None else int(h.sum()) for h in hits], pa.int64()),
                    pa.array([sorted(x) for x in ids], pa.list_(pa.string())),
                    pa.array(
                        [[] if h is None else char_spans(t, h) for t, h in zip(texts, hits, strict=True)],
                        pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
                    ),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_hit", "item_ids", "spans"])
            else:
                columns.append(pa.array([None if h is None else np.packbits(h).tobytes() for h in hits], pa.binary()))
                columns.append(pa.array([sorted(x) for x in ids], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, [*names, "_hit", "_ids"])

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without those that hold any window of a benchmark item; all columns stay as they are."""
    rows = shielded(docs)
    scanned = find_contamination(rows, benchmark, window, keep=tuple(c for c in rows.columns if c != "doc_id"))
    return unshielded(scanned.filter("n_hit = 0"), docs)
