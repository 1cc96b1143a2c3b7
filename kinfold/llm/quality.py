"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), in time linear in the features.
Features: the distinct blank-separated tokens of the whole text hashed into ``2**bits`` slots (each 1/sqrt(count)),
bucketed structure statistics (shares of capitals, punctuation and digits, token length, distinct tokens, repeated
lines, short lines), and the bucketed length in the metadata column n_chars.

Fitting takes at most about ``fit_rows`` labelled rows, chosen by hash of the id; scoring covers every whole text.

Defined results: a null text counts as empty and is scored by its structure features; a null or missing n_chars has a
bucket of its own; rows with a null label are not learned from; without labels every score is 0.5; a document with
several label rows takes the largest label; ties need no rule, since scores are independent; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, bounded_sample, giving_back, rows_of, shielded, unshielded

_SLOTS: dict[bytes, int] = {}
_KINDS = bytes(
    1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 or c >= 128 else 3 if 48 <= c <= 57 else 4 if c in (9, 10, 11, 12, 13, 32) else 0
    for c in range(256)
)
BUCKETS, STATS = 16, 9


def slot(token: bytes, bits: int) -> int:
    found = _SLOTS.get(token)
    if found is None:
        if len(_SLOTS) > 400_000:
            _SLOTS.clear()
        found = _SLOTS[token] = zlib.crc32(token) & ((1 << bits) - 1)
    return found


def features(text: bytes | None, n_chars: int | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots and values of one document."""
    raw = text or b""
    tokens = raw.split()
    distinct = set(tokens)
    kinds = np.bincount(np.frombuffer(raw.translate(_KINDS), np.uint8), minlength=5) if raw else np.zeros(5, np.int64)
    n, visible = max(1, len(tokens)), max(1, len(raw) - int(kinds[4]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = (
        kinds[1] / visible,
        kinds[0] / visible,
        kinds[3] / visible,
        min(1.0, len(raw) / n / 24),
        len(distinct) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 40 for x in lines) / max(1, len(lines)),
        min(1.0, np.log2(1 + len(tokens)) / 16),
    )
    base = 1 << bits
    own = [base + k * BUCKETS + min(BUCKETS - 1, int(s * BUCKETS)) for k, s in enumerate(shares)]
    own.append(base + 8 * BUCKETS + (BUCKETS - 1 if n_chars is None else min(BUCKETS - 2, int(np.log2(1 + max(0, n_chars))))))
    get = _SLOTS.get
    words = [s if (s := get(t)) is not None else slot(t, bits) for t in distinct]
    values = np.empty(len(words) + len(own), np.float32)
    values[: len(words)] = 1 / np.sqrt(max(1, len(words)))
    values[len(words) :] = 1 / 3
    return np.array(words + own, np.int32), values


class FactorisationMachine:
    def __init__(self, bits: int = 15, rank: int = 8) -> None:
        self.bits, self.w0 = bits, np.float32(0)
        size = (1 << bits) + STATS * BUCKETS
        self.w = np.zeros(size, np.float32)
        self.v = np.random.default_rng(7).normal(0, 0.05, (size, rank)).astype(np.float32)

    def margins(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[slots] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return self.w0 + np.add.reduceat(self.w[slots] * values, starts) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.1, decay: float = 1e-5) -> None:
        """AdaGrad on the logistic loss, in a fixed order of rows and epochs."""
        order = np.random.default_rng(11)
        gw, gv, g0 = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(epochs):
            for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
                slots = np.concatenate([rows[i][0] for i in part])
                values = np.concatenate([rows[i][1] for i in part])
                sizes = np.array([len(rows[i][0]) for i in part])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                margin, sums = self.margins(slots, values, starts)
                error = ((1 / (1 + np.exp(-margin)) - labels[part]) / len(part)).astype(np.float32)
                each = np.repeat(error, sizes) * values
                used, inverse = np.unique(slots, return_inverse=True)
                dw = np.bincount(inverse, each, len(used)).astype(np.float32) + decay * self.w[used]
                grad = each[:, None] * (np.repeat(sums, sizes, axis=0) - self.v[slots] * values[:, None])
                dv = np.stack([np.bincount(inverse, grad[:, f], len(used)) for f in range(grad.shape[1])], 1).astype(np.float32) + decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                g0 += float(error.sum()) ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
                self.w0 -= np.float32(rate * float(error.sum()) / np.sqrt(g0))


def _with_chars(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", F.col("text").cast("binary").alias("_text"), chars.alias("_chars"))


def fit_quality_model(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, bits: int = 15, rank: int = 8) -> FactorisationMachine | None:
    """Fit on documents joined to labels (doc_id, quality); None if there are no labelled rows."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_y"))
    rows = _with_chars(docs).join(bounded_sample(known, fit_rows), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1000):
            made = [features(t, c, bits)[0].tobytes() for t, c in zip(batch.column("_text").to_pylist(), batch.column("_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), pa.array(made, pa.binary())], ["doc_id", "_y", "x"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = sorted(rows.select("doc_id", "_y", "_text", "_chars").mapInArrow(giving_back(extract), f"doc_id {kinds['doc_id']}, _y {kinds['_y']}, x binary").collect())
    if not found:
        return None
    n_own = STATS
    packed = []
    for r in found:
        slots = np.frombuffer(r.x, np.int32)
        values = np.full(len(slots), 1 / np.sqrt(max(1, len(slots) - n_own)), np.float32)
        values[-n_own:] = 1 / 3
        packed.append((slots, values))
    model = FactorisationMachine(bits, rank)
    model.fit(packed, np.array([float(r._y) for r in found], np.float32))
    return model


def score_quality(docs: DataFrame, model: FactorisationMachine | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``keep`` columns and the score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in rows_of(batches, 256):
            if model is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                chars = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else [None] * batch.num_rows
                made = [features(t, c, model.bits) for t, c in zip(binary_column(batch, "text"), chars, strict=True)]
                starts = np.cumsum([0] + [len(s) for s, _ in made])[:-1]
                margin, _ = model.margins(np.concatenate([s for s, _ in made]), np.concatenate([x for _, x in made]), starts)
                scores = 1 / (1 + np.exp(-margin.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", *keep)] + [pa.array(scores, pa.float64())], ["doc_id", *keep, "score"])

    kept = [docs.schema[c] for c in ("doc_id", *keep)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double"
    needed = dict.fromkeys(("doc_id", *keep, "text", *(["n_chars"] if "n_chars" in docs.columns else [])))
    return docs.select(*needed).mapInArrow(giving_back(score), schema)


def keep_good(docs: DataFrame, model: FactorisationMachine | None, least: float = 0.7) -> DataFrame:
    """The documents that the classifier accepts; all columns stay as they are."""
    rows = shielded(docs)
    scored = score_quality(rows, model, keep=tuple(c for c in rows.columns if c != "doc_id"))
    return unshielded(scored.filter(F.col("score") >= least), docs)
