"""Exact top-k search of binary codes by incremental multi-index hashing.

An embedding becomes a code of one sign bit for each dimension (1 if positive), cut into segments of 16 bits. Every shard
of the index has one bucket table for each segment. A query grows its search radius one segment at a time: all buckets
whose segment differs from the query's in r bits are read and their codes verified. If all segments have been searched to
radius r and j of them to r + 1, every code within distance m * (r + 1) + j - 1 has been seen; the search ends when the
kth best verified distance is within that. When the next radius has more buckets than the shard has unseen codes, these
are verified at once, which covers everything.

Equal codes are one entry with their k smallest ids (no other row of that code can be among the first k), so a hot
vector is one row. Queries go to the shards in blocks of at most ``block`` codes; the best k of each shard are merged.

Defined results: ties in distance go to the smaller vec_id; a query does not find its own vec_id; null elements and NaN
are 0 bits; rows with a null embedding or vec_id are neither indexed nor searched; repeated rows of a vec_id count once;
with fewer than k others, all are returned; embeddings shorter than the longest are padded with 0 bits; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_width

SEGMENT = 16


def sign_codes(vectors: DataFrame) -> DataFrame:
    """vec_id and its code: packed sign bits, the first dimension in the highest bit of the first byte."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            flat = np.nan_to_num(column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)) > 0
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            codes = [np.packbits(flat[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(codes, pa.binary())], ["vec_id", "code"])

    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(encode, "vec_id long, code binary")


def _masks() -> list[np.ndarray]:
    return [np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), r)], np.int64) for r in range(SEGMENT + 1)]


MASKS = _masks()
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class CodeIndex:
    """Distinct codes of one shard with a bucket table for each segment."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes  # rows of bytes, an even number of columns
        parts = codes.view(">u2").astype(np.int64)
        self.order = [np.argsort(parts[:, s], kind="stable") for s in range(parts.shape[1])]
        self.edges = [np.searchsorted(parts[o, s], np.arange((1 << SEGMENT) + 1)) for s, o in enumerate(self.order)]

    def search(self, query: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of codes, among them all that are as near as the want-th nearest."""
        n, m = len(self.codes), len(self.order)
        seen = np.zeros(n, bool)
        parts = query.view(">u2").astype(np.int64)
        numbers, distances = [], []
        within = np.zeros(SEGMENT * m + 1, np.int64)
        for radius in range(SEGMENT + 1):
            for s in range(m):
                covered = m * radius + s - 1
                if covered >= 0 and within[: covered + 1].sum() >= want:
                    return np.concatenate(numbers), np.concatenate(distances)
                left = n - int(seen.sum())
                if not left:
                    break
                if len(MASKS[radius]) * (m - s) >= left:
                    fresh = np.flatnonzero(~seen)
                else:
                    at = parts[s] ^ MASKS[radius]
                    lo, hi = self.edges[s][at], self.edges[s][at + 1]
                    full = hi > lo
                    fresh = np.concatenate([np.zeros(0, np.int64), *(self.order[s][a:b] for a, b in zip(lo[full], hi[full], strict=True))])
                    fresh = fresh[~seen[fresh]]
                seen[fresh] = True
                d = _ONES[self.codes[fresh] ^ query].sum(1, dtype=np.int64)
                within += np.bincount(d, minlength=len(within))
                numbers.append(fresh)
                distances.append(d)
        return np.concatenate([np.zeros(0, np.int64), *numbers]), np.concatenate([np.zeros(0, np.int64), *distances])


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int, block: int = 65_536, shard_codes: int = 65_536) -> DataFrame:
    """query_id, vec_id, distance and rank of the k nearest codes of every query; both frames have vec_id and code."""
    spark = codes.sparkSession
    own = codes.dropDuplicates(["vec_id"])
    best = own.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    index = materialise(best.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "codes")
    shape = index.agg(F.count("*").alias("n"), F.max(F.length("code")).alias("width")).first()
    schema = "query_id long, vec_id long, distance int"
    if not shape["n"]:
        return spark.createDataFrame([], schema + ", rank int")
    width = -(-shape["width"] // 2) * 2
    parts = max(1, -(-shape["n"] // shard_codes))
    shards = index.repartition(max(parts, min(shuffle_width(index), -(-shape["n"] // 4096))), "code")
    asked = queries.dropDuplicates(["vec_id"])
    blocks = max(1, -(-asked.count() // block))
    found = None
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).orderBy("vec_id").collect()  # at most about one block
        sent = spark.sparkContext.broadcast([(r.vec_id, bytes(r.code).ljust(width, b"\0")) for r in rows])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            codes, ids = [], []
            for batch in batches:
                codes += batch.column("code").to_pylist()
                ids += batch.column("ids").to_pylist()
            if not codes:
                return
            table = CodeIndex(np.frombuffer(b"".join(c.ljust(width, b"\0") for c in codes), np.uint8).reshape(-1, width))
            out: list[tuple[int, int, int]] = []
            for query, code in sent.value:
                numbers, distances = table.search(np.frombuffer(code, np.uint8), k + 1)
                order = np.argsort(distances, kind="stable")
                limit = distances[order[min(k, len(order) - 1)]]
                near = sorted((int(distances[i]), v) for i in order[: np.searchsorted(distances[order], limit, "right")] for v in ids[numbers[i]] if v != query)
                out += [(query, v, d) for d, v in near[:k]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32())], ["query_id", "vec_id", "distance"])

        one = shards.mapInArrow(search, schema)
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest_embeddings(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """Top-k by Hamming distance of sign codes; queries are the rows whose vec_id is divisible by ``every``."""
    codes = materialise(sign_codes(vectors), "signs")
    return nearest_codes(codes, codes.filter(F.col("vec_id") % every == 0), k)
