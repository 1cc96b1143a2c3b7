"""Conflict-constrained best-fit packing of documents into training sequences.

A document of n tokens (blank-separated words, or a given column) is cut into full sequences of ``capacity`` and a rest.
Full pieces have a bin each. Rests are placed in falling order of size: bins stand in order of their free space, each
with bitmaps of the duplicate clusters and sources that it holds; the search starts at the tightest bin that has room and
goes on to the next wider one until neither bitmap forbids it. A bin holds at most one document of a cluster and
``max_per_source`` of a source (one bit plane for each). If no bin is left, a new one opens.

``pack_documents`` takes equal texts (up to case and blanks) as a cluster, ``pack_apart`` near-duplicates too.

Best fit is sequential, so documents are dealt by hash of the id into shards of about ``shard_rows`` documents that are
packed independently; a hot source or cluster is spread evenly over all shards. Each shard leaves few open bins.

Defined results: a null or wordless text has one row with 0 tokens and no bin; ties in size go to the smaller doc_id,
ties in free space to the older bin; a null source or cluster never conflicts; repeated rows are packed each (as one
cluster they do not share a bin); a doc_id that is no integer raises TypeError; an empty table gives an empty result; a very
long text has many full pieces; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, integer_id, materialise, rows_of, shuffle_width
from .minhash import near_duplicates


def best_fit(items: list[tuple[int, object, object]], capacity: int, max_per_source: int) -> list[tuple[int, int]]:
    """(bin, start) for each (size, source, cluster), in the order given; sizes are 1 to capacity."""
    bits: dict[object, int] = {}
    often: dict[object, int] = {}
    for _, _, cluster in items:
        often[cluster] = often.get(cluster, 0) + 1
    standing: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space, oldest first
    used = 0  # bit r: some bin has r tokens free
    clusters: list[int] = []
    planes: list[list[int]] = []
    out = []
    for size, source, cluster in items:
        # A cluster with one member, or a null, cannot conflict and needs no bit.
        c = 0 if cluster is None or often[cluster] < 2 else 1 << bits.setdefault(("c", cluster), len(bits))
        s = 0 if source is None else 1 << bits.setdefault(("s", source), len(bits))
        wider, free, chosen = used >> size, size, -1
        while wider:
            step = (wider & -wider).bit_length() - 1
            free += step
            for b in standing[free]:
                if not clusters[b] & c and not planes[b][-1] & s:
                    chosen = b
                    break
            if chosen >= 0:
                break
            wider, free = wider >> (step + 1), free + 1
        if chosen < 0:
            chosen, free = len(clusters), capacity
            clusters.append(0)
            planes.append([0] * max_per_source)
        else:
            standing[free].remove(chosen)
            if not standing[free]:
                used &= ~(1 << free)
        out.append((chosen, capacity - free))
        clusters[chosen] |= c
        for k, plane in enumerate(planes[chosen]):
            if not plane & s:
                planes[chosen][k] |= s
                break
        left = free - size
        if left:
            row = standing[left]
            row.insert(int(np.searchsorted(row, chosen)), chosen)
            used |= 1 << left
    return out


def print_of(text: bytes | None) -> int | None:
    words = (text or b"").lower().split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def sized(docs: DataFrame, cluster: F.Column | None = None) -> DataFrame:
    """doc_id, source, cluster (or else a hash of the lower-cased words) and n_tokens (blank-separated words) of every document."""

    given = [] if cluster is None else [cluster.alias("cluster")]
    made = not given

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 2000):
            texts = binary_column(batch, "text")
            sizes = [len((t or b"").lower().split()) for t in texts]
            own = batch.column("cluster") if not made else pa.array([print_of(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), own, pa.array(sizes, pa.int64())], ["doc_id", "source", "cluster", "n_tokens"]
            )

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(integer_id(docs).alias("doc_id"), source.alias("source"), *given, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(measure, "doc_id long, source string, cluster long, n_tokens long")


def pack(items: DataFrame, n_rows: int, capacity: int = 2048, max_per_source: int = 4, shard_rows: int = 4096) -> DataFrame:
    """items: doc_id, source, cluster, n_tokens. Returns doc_id, piece, n_tokens, bin_id and start of every piece."""
    shards = max(1, -(-n_rows // shard_rows))
    parts = min(shuffle_width(items), shards)
    # A null id is dealt like the others, by the rest of its row.
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).cast("int"))
    dealt = dealt.withColumn("rest", F.col("n_tokens") % capacity)
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard", F.desc("rest"), "doc_id", "cluster", "source")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "source", "cluster", "n_tokens")), strict=True):
                if rows and rows[0][0] != row[0]:
                    yield filled(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield filled(rows)

    def filled(rows: list[tuple]) -> pa.RecordBatch:
        base = rows[0][0] << 32
        small = [r for r in rows if r[4] % capacity]
        placed = best_fit([(r[4] % capacity, r[2], r[3]) for r in small], capacity, max_per_source)
        n = 1 + max((b for b, _ in placed), default=-1)
        out = [(r[1], r[4] // capacity, r[4] % capacity, base + b, at) for r, (b, at) in zip(small, placed, strict=True)]
        for r in rows:
            for piece in range(r[4] // capacity):
                out.append((r[1], piece, capacity, base + n, 0))
                n += 1
            if not r[4]:
                out.append((r[1], 0, 0, None, None))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(5)], ["doc_id", "piece", "n_tokens", "bin_id", "start"])

    return dealt.select("shard", "doc_id", "source", "cluster", "n_tokens").mapInArrow(fill, "doc_id long, piece long, n_tokens long, bin_id long, start long")


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    return pack(sized(docs), docs.count(), **options)


def near_clusters(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """cluster, component: the smallest hash of the near-duplicates of a text, where that is another one's."""
    # The hash stands for the id, so null and repeated ids have their clusters too.
    found = near_duplicates(docs.select(F.xxhash64("text").alias("doc_id"), "text"), width, percent, text_ids=True)
    return materialise(found.filter("doc_id <> component_id").groupBy(F.col("doc_id").alias("cluster")).agg(F.min("component_id").alias("component")), "clusters")


def pack_apart(docs: DataFrame, **options) -> DataFrame:
    """pack_documents with near-duplicates (five-word shingles, similarity 0.8 or more) as clusters."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    items = sized(docs, F.xxhash64("text")).join(near_clusters(docs), "cluster", "left").withColumn("cluster", F.coalesce("component", "cluster")).drop("component")
    return pack(items, docs.count(), **options)
