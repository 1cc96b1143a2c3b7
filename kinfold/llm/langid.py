"""Language identification by word-first backoff.

A word that training has seen is scored by its log frequency in each language. An unseen word falls back to the longest
character n-grams of it that are known, from ``max_n`` down to single characters. A document's language is the one with
the largest sum over its words; ``score`` is its share of the posterior.

Fitting reads a sample of at most about ``fit_rows`` labelled documents, chosen by hash of the id (a bound of the model,
not of the data to be scored); every text is scored whole. Words and n-grams are counted over the whole sample. Of the
words, each language keeps its ``max_words`` / (number of languages) most frequent ones, and of the n-grams of each length
its share of ``max_grams``, with the counts of all languages; so a rare language has as many as a frequent one. That
bounds the broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0; documents with a null language are not
learned from; with no labelled document at all, every text is ``und``; ties go to the language that sorts first; letters
no language has shown give equal shares; a language of few documents keeps all its words; a very long text is scored as
any other, with 16 bytes a word and language beside it; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, discard, materialise, rows_of

_LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def letter_words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


class LogTable:
    """Rows of log frequencies, one column for each language, by word or n-gram."""

    def __init__(self, counts: dict[str, list[int]], width: int, add: float = 0.5) -> None:
        rows = np.array(list(counts.values()), np.float64).reshape(len(counts), width) + add
        self.number = {x: k for k, x in enumerate(counts)}
        self.logs = np.log(rows / rows.sum(0)) if len(rows) else rows


class BackoffModel:
    """words and grams (by length from 1 on): counts by language, in the order of langs."""

    def __init__(self, langs: list[str], words: dict[str, list[int]], grams: list[dict[str, list[int]]]) -> None:
        self.langs = langs
        self.words = LogTable(words, len(langs))
        self.grams = [LogTable(x, len(langs)) for x in grams]

    def unseen(self, words: list[str]) -> np.ndarray:
        """For each word the mean row of its longest known n-grams; zeros if it has none."""
        out, left = np.zeros((len(words), len(self.langs))), range(len(words))
        for size in range(len(self.grams), 0, -1):
            table, numbers, hits, rest = self.grams[size - 1], [], [], []
            get = table.number.get
            for i in left:
                known = [k for g in ngrams(words[i], size) if (k := get(g)) is not None]
                if known:
                    numbers += known
                    hits.append((i, len(known)))
                else:
                    rest.append(i)
            if hits:
                n = np.array([k for _, k in hits])
                out[[i for i, _ in hits]] = np.add.reduceat(table.logs[numbers], np.cumsum(n) - n) / n[:, None]
            left = rest
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        split = [letter_words(t) if self.langs else [] for t in texts]
        flat = [w for words in split for w in words]
        if not flat:
            return [(UNKNOWN, 0.0)] * len(texts)
        base, fresh = len(self.words.number), {}
        get = self.words.number.get
        number = np.fromiter((k if (k := get(w)) is not None else base + fresh.setdefault(w, len(fresh)) for w in flat), np.int64, len(flat))
        rows = np.empty((len(flat), len(self.langs)))
        seen = number < base
        rows[seen] = self.words.logs[number[seen]]
        rows[~seen] = self.unseen(list(fresh))[number[~seen] - base]
        sizes = np.array([len(words) for words in split])
        full = sizes > 0
        total = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[full])
        share = np.exp(total - total.max(1, keepdims=True))
        best = share.argmax(1)
        found = zip(best.tolist(), (share[np.arange(len(best)), best] / share.sum(1)).tolist(), strict=True)
        return [(self.langs[x[0]], x[1]) if f and (x := next(found)) else (UNKNOWN, 0.0) for f in full.tolist()]


def ngrams(word: str, size: int) -> list[str]:
    padded = f"^{word}$" if size > 1 else word
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def _with_all_languages(counts: DataFrame, key: str, langs: list[str], share: int) -> dict[str, list[int]]:
    """Counts (key, lang, n) of the ``share`` most frequent keys of each language, in all languages."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), key))
    top = counts.withColumn("k", rank).filter(F.col("k") <= share).select(key).distinct()
    rows = counts.join(top, key, "left_semi").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("x"))
    column = {x: k for k, x in enumerate(langs)}
    out = {}
    for r in sorted(rows.collect()):  # at most the share of each language
        out[r[0]] = own = [0] * len(langs)
        for lang, n in r.x:
            own[column[lang]] = n
    return out


def fit_language_model(labelled: DataFrame, fit_rows: int = 20_000, max_words: int = 100_000, max_grams: int = 200_000, max_n: int = 4) -> BackoffModel:
    """labelled: doc_id, text, lang; rows with a null text or lang are left out."""
    rows = bounded_sample(labelled.filter("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang")), fit_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 2000):
            seen: Counter = Counter()
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                seen.update((lang, w) for w in letter_words(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    counted = materialise(rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if not langs:
        return BackoffModel([], {}, [])
    words = _with_all_languages(counted, "word", langs, max(1, max_words // len(langs)))
    grams = []
    for size in range(1, max_n + 1):
        padded = "word" if size == 1 else "concat('^', word, '$')"
        pieces = F.expr(f"transform(sequence(1, greatest(1, length({padded}) - {size - 1})), i -> substring({padded}, i, {size}))")
        each = counted.select("lang", "n", F.explode(pieces).alias("gram")).filter(F.length("gram") == size).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
        grams.append(_with_all_languages(each, "gram", langs, max(1, max_grams // max_n // len(langs))))
    discard(counted)
    return BackoffModel(langs, words, grams)


def identify_language(docs: DataFrame, model: BackoffModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``keep`` columns, lang_pred and score for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 500):
            out = sent.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", *keep)] + [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                ["doc_id", *keep, "lang_pred", "score"],
            )

    kept = [docs.schema[c] for c in ("doc_id", *keep)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"
    return docs.select("doc_id", *keep, "text").mapInArrow(score, schema)
