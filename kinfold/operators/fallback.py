"""Character n-gram TF-IDF neighbours for records that blocking leaves with few candidates.

Weights follow the usual smooth form: raw counts times ln((1 + N) / (1 + df)) + 1, scaled to length 1, with N and df of
the pool part that a record is compared with. A part is a country, or, where ``pool_limit`` is given, a country and first
character where the country has more records than that; None compares with the whole country. Only pool records that
share an n-gram are scored; ties go to the smaller id.

Texts meet in tiles: a block of weak records, a slice of the pool part and the part's weights. A tile keeps its own top_k
of each record in NumPy, so nothing of the size of pairs times n-grams, or of pairs, is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as X
from ..sources.staging import materialise

#: Weak records and pool records of a tile, and pool records that are scored at once.
WEAK_BLOCK, POOL_TILE, STEP = 512, 32_768, 4_096
#: An n-gram in more than this share of the records scored at once is a column of a dense product.
DENSE = 0.05
PART = ["country", "bucket"]


def parts(weak: DataFrame, pool: DataFrame, pool_limit: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with country and bucket; records whose country the pool lacks drop out."""
    sizes = F.broadcast(pool.groupBy(F.trim("country").alias("country")).agg(F.count("*").alias("n_country")))

    def side(df: DataFrame) -> DataFrame:
        out = df.withColumn("country", F.trim("country")).join(sizes, "country")
        bucket = F.lit("*")
        if pool_limit is not None:
            bucket = F.when(F.col("n_country") > pool_limit, X.first_character(F.col("normalized_name"))).otherwise(bucket)
        text = F.concat_ws(" ", "normalized_name", "normalized_address")
        return out.select("entity_id", "country", bucket.alias("bucket"), text.alias("text"))

    return side(weak), side(pool)


def _grams(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of each n-gram of one to three characters, with repeats; a code holds the characters, 21 bits each."""
    each = words.flatten()
    lengths = pc.utf8_length(each).to_numpy(zero_copy_only=False)
    chars = np.frombuffer("".join(each.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    word = np.repeat(np.arange(len(each)), lengths)
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))[word]
    two, three = word[1:] == word[:-1], word[2:] == word[:-2]
    pairs, triples = chars[:-1] << 21 | chars[1:], (chars[:-2] << 42) | (chars[1:-1] << 21) | chars[2:]
    return np.concatenate([row, row[:-1][two], row[:-2][three]]), np.concatenate([chars, pairs[two], triples[three]])


def _counted(rows: np.ndarray, grams: np.ndarray, n_grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, gram) in order, and how often each occurs."""
    keys = np.sort(rows * n_grams + grams)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first] // n_grams, keys[first] % n_grams, np.diff(first, append=len(keys))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(country, bucket, code, df) of each batch of (country, bucket, words)."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for key in table.group_by(PART).aggregate([]).to_pylist():
            mine = table.filter(pc.and_(pc.equal(table["country"], key["country"]), pc.equal(table["bucket"], key["bucket"])))
            rows, codes = _grams(mine["words"].combine_chunks())
            known, at = np.unique(codes, return_inverse=True)
            if not len(known):
                continue
            _, grams, _ = _counted(rows, at, len(known))
            n = len(known)
            yield pa.record_batch([pa.array([key["country"]] * n), pa.array([key["bucket"]] * n), pa.array(known), pa.array(np.bincount(grams, minlength=n))], names=[*PART, "code", "df"])


def _unit(words: pa.ListArray, codes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, weight) of vectors of length 1, in order of row; n-grams that the pool part lacks have no weight."""
    rows, found = _grams(words)
    at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
    known = codes[at] == found
    rows, grams, tf = _counted(rows[known], at[known], len(codes))
    w = tf * idf[grams]
    return rows, grams, w / np.sqrt(np.bincount(rows, w * w, len(words)))[rows]


def _dots(ours: tuple, n_ours: int, theirs: tuple, n_theirs: int, n_grams: int) -> np.ndarray:
    """All dot products: frequent n-grams by a dense product, the others entry by entry."""
    (r1, g1, w1), (r2, g2, w2) = ours, theirs
    df = np.bincount(g2, minlength=n_grams)
    often = np.flatnonzero(df > DENSE * n_theirs)
    column = np.full(n_grams, -1)
    column[often] = np.arange(len(often))

    def dense(rows, grams, w, n):
        out, at = np.zeros((n, len(often))), column[grams]
        out[rows[at >= 0], at[at >= 0]] = w[at >= 0]
        return out

    out = dense(r1, g1, w1, n_ours) @ dense(r2, g2, w2, n_theirs).T
    rare1, rare2 = column[g1] < 0, column[g2] < 0
    order = np.argsort(g2[rare2], kind="stable")
    r2, w2, g2 = r2[rare2][order], w2[rare2][order], g2[rare2][order]
    r1, w1, g1 = r1[rare1], w1[rare1], g1[rare1]
    low = np.searchsorted(g2, g1)
    n = np.searchsorted(g2, g1, "right") - low
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    cells = np.repeat(r1 * n_theirs, n) + r2[at]
    return out + np.bincount(cells, np.repeat(w1, n) * w2[at], n_ours * n_theirs).reshape(n_ours, n_theirs)


def _tile(top_k: int):
    """The top_k of each weak record within one tile: rows are weights (id null), weak records (weak) or pool records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        weak, pool = (table.filter(pc.equal(table["weak"], side)).sort_by("id") for side in (True, False))
        weights = table.filter(pc.is_null(table["id"]))
        if not (len(weak) and len(pool) and len(weights)):
            return
        codes, idf = weights["code"].to_numpy(), weights["idf"].to_numpy()
        order = np.argsort(codes)
        codes, idf = codes[order], idf[order]
        ours, n = _unit(weak["words"].combine_chunks(), codes, idf), len(weak)
        none = np.iinfo(np.int64).max
        best = np.full((n, 0), none)
        for at in range(0, len(pool), STEP):
            slab = pool.slice(at, STEP)
            dots = _dots(ours, n, _unit(slab["words"].combine_chunks(), codes, idf), len(slab), len(codes))
            # Similarity in millionths, descending, then the place of the id.
            keys = ((1 << 21) - np.floor(dots * 1e6 + 0.5).astype(np.int64) << 32) | np.arange(at, at + len(slab))
            best = np.concatenate([best, np.where(dots > 0, keys, none)], axis=1)
            if best.shape[1] > top_k:
                best = np.partition(best, top_k - 1, axis=1)[:, :top_k]
        rows, places = np.nonzero(best < none)
        keys = best[rows, places]
        similarity = ((1 << 21) - (keys >> 32)) / 1e6
        names = [weak["id"].combine_chunks().take(pa.array(rows)), pool["id"].combine_chunks().take(pa.array(keys & 0xFFFFFFFF))]
        yield pa.record_batch([*names, pa.array(similarity)], names=["s1_id", "cand_id", "similarity"])

    return run


def tfidf_neighbours(weak: DataFrame, pool: DataFrame, top_k: int = 15, pool_limit: int | None = 20_000, analyzer: str = "char_wb") -> DataFrame:
    """(s1_id, cand_id, similarity, rnk): the top_k most similar pool records of each weak record."""

    def texts(df: DataFrame) -> DataFrame:
        words = df.withColumn("words", X.padded_words(F.col("text"), analyzer))
        return words.groupBy("entity_id", *PART).agg(F.flatten(F.collect_list("words")).alias("words"), F.count("*").alias("n"))

    ours, theirs = (materialise(texts(df), "texts") for df in parts(weak, pool, pool_limit))
    counts = theirs.select(*PART, "words").mapInArrow(_document_counts, "country string, bucket string, code long, df long")
    docs = theirs.groupBy(*PART).agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_pool"))
    sizes = docs.join(ours.groupBy(*PART).agg(F.count("*").alias("n_weak")), PART)
    sizes = sizes.select(*PART, "n_docs", F.ceil(F.col("n_pool") / POOL_TILE).cast("int").alias("tiles"), F.ceil(F.col("n_weak") / WEAK_BLOCK).cast("int").alias("blocks"))
    sizes = F.broadcast(materialise(sizes, "parts"))

    def every(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def of(n: str) -> F.Column:
        return F.pmod(F.xxhash64("entity_id"), F.col(n)).cast("int")

    rows = ["block", "tile", "weak", F.col("entity_id").alias("id"), "words", F.lit(None).cast("long").alias("code"), F.lit(None).cast("double").alias("idf")]
    left = ours.join(sizes, PART).withColumn("block", of("blocks")).withColumn("tile", every("tiles")).withColumn("weak", F.lit(True)).select(*PART, *rows)
    right = theirs.join(sizes, PART).withColumn("tile", of("tiles")).withColumn("block", every("blocks")).withColumn("weak", F.lit(False)).select(*PART, *rows)
    idf = counts.groupBy(*PART, "code").agg(F.sum("df").alias("df")).join(sizes, PART).withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)
    idf = materialise(idf.select(*PART, "tiles", "blocks", "code", "idf"), "idf").withColumn("block", every("blocks")).withColumn("tile", every("tiles"))
    idf = idf.select(*PART, "block", "tile", F.lit(None).cast("boolean").alias("weak"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("array<string>").alias("words"), "code", "idf")
    near = left.unionByName(right).unionByName(idf).groupBy(*PART, "block", "tile").applyInArrow(_tile(top_k), "s1_id string, cand_id string, similarity double")
    window = Window.partitionBy("s1_id").orderBy(F.desc("similarity"), "cand_id")
    return near.withColumn("rnk", F.row_number().over(window)).filter(F.col("rnk") <= top_k)


def merge_fallback(ranked: DataFrame, extra: DataFrame, cap: int) -> DataFrame:
    """Ranked candidates followed by new ones in order of id, cut to the cap: s1_id, cand_id, votes, stage, rnk."""
    fresh = extra.select("s1_id", "cand_id").join(ranked.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    both = ranked.select("s1_id", "cand_id", "votes", F.lit(0).alias("stage"), "rnk").unionByName(
        fresh.select("s1_id", "cand_id", F.lit(0).cast("long").alias("votes"), F.lit(1).alias("stage"), F.lit(0).alias("rnk"))
    )
    window = Window.partitionBy("s1_id").orderBy("stage", "rnk", "cand_id")
    return both.withColumn("rnk", F.row_number().over(window)).filter(F.col("rnk") <= cap)
