"""Near-duplicate groups by min-max hashing, with every link confirmed on the full shingle sets.

A document's set holds its distinct runs of ``width`` words. Each of ``bands * rows / 2`` hash functions is evaluated once
for each shingle, and both its minimum and its maximum enter the signature; the signature is cut into ``bands`` keys of
``rows`` values. With 3 rows and 22 bands a pair at the default threshold of 0.85 shares no key with probability
(1 - 0.85^3)^22, below 1e-9.

1. Documents with equal sets form one class; its smallest doc_id stands for it. Only representatives have keys.
2. Representatives that share a key are candidates. First each is compared with the hub of its key: the one that shares
   most keys with others, all in all (the text that copies were made from rather than a copy). The confirmed links give
   components.
3. Where the members under a hub fall into several components, pairs across components remain. Let h be the hub. A pair x, y whose common shingles are all in h has at most i = |x and h| of
   them, so it can link only if |y| <= i (1 + t) / t - |x|; any other pair must meet in the rarest of the shingles that h
   lacks. Pairs that pass one of the two tests are compared in waves, a bounded number for each pair of components in a
   wave, until every such pair has been compared or has come to lie in one component.
4. Components come from alternating large-star and small-star steps on tables in the shared folder.

So no pair is dropped and no group is gathered: hubs are maxima of partial aggregates, and hot keys are split by the
skewed-join rule.

Defined results: null, empty or blank texts have the empty set and link with nothing; a text of fewer than ``width`` words
is one shingle; rows of one doc_id are one document, which links with what any of its texts links with (n_shingles is each
row's own); a row with a null doc_id gets a null component and is kept; a doc_id that is no integer raises TypeError; an
empty table gives an empty result; extra columns are ignored. A very long text is split into words piece by piece; what
stays in memory of it are its hashes, 8 bytes a word a few times over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_column, blank_words, discard, giving_back, integer_id, materialise, rows_of, shuffle_width

_BLANK = re.compile(rb"\s")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]


def word_hashes(text: bytes | None, piece: int = 1 << 22) -> np.ndarray:
    """Hashes of the words of a text, which is split a piece at a time."""
    if text and len(text) > piece:
        parts, at = [], 0
        while at < len(text):
            cut = _BLANK.search(text, at + piece)
            to = cut.start() if cut else len(text)
            parts.append(word_hashes(text[at:to], to - at))
            at = to
        return np.concatenate(parts)
    words = blank_words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word runs of a text."""
    each = word_hashes(text)
    if not len(each):
        return each
    n = max(1, len(each) - width + 1)
    total = np.full(n, min(width, len(each)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(each))):
            total = (total * _MIX[0] + each[k : k + n]) * _MIX[1]
            total ^= total >> np.uint64(29)
        total *= _MIX[3]
    total ^= total >> np.uint64(32)
    return np.unique(total)


@lru_cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and summands of the hash functions."""
    rng = np.random.default_rng(1009)
    return rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signature_keys(hashes: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """For each non-empty set one 64-bit key for each band of its min-max signature."""
    mul, add = _functions(-(-bands * rows // 2))
    flat = np.concatenate(hashes)
    starts = np.cumsum([0] + [len(h) for h in hashes])[:-1]
    values = np.empty((2 * len(mul), len(hashes)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(len(mul)):
            image = flat * mul[k] + add[k]
            values[2 * k] = np.minimum.reduceat(image, starts)
            values[2 * k + 1] = np.maximum.reduceat(image, starts)
        values = values[: bands * rows].reshape(bands, rows, len(hashes))
        key = np.repeat((np.arange(bands, dtype=np.uint64) * _MIX[2])[:, None], len(hashes), 1)
        for k in range(rows):
            key = (key ^ values[:, k]) * _MIX[0]
            key ^= key >> np.uint64(31)
    return key.T


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (16 bytes, null for the empty set), keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 200):
            sets = [shingle_hashes(text, width) for text in binary_column(batch, "text")]
            full = [h for h in sets if len(h)]
            keys = iter(signature_keys(full, bands, rows).astype(np.int64)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(h) for h in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets], pa.binary()),
                    pa.array([next(keys) if len(h) else [] for h in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_hash", "keys"],
            )

    return docs.mapInArrow(giving_back(sign), "doc_id long, n_shingles long, set_hash binary, keys array<long>")


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text as a zstandard frame."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in rows_of(batches, 2000):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([packer.compress(t or b"") for t in binary_column(batch, "text")], pa.binary())], ["doc_id", "packed"]
            )

    return docs.mapInArrow(giving_back(pack), "doc_id long, packed binary")


def texts_of(docs: DataFrame, ids: DataFrame, small: int = 8 << 20) -> DataFrame:
    """doc_id and packed text of the ids; up to ``small`` bytes of ids are broadcast, so that no other text is packed or shuffled."""
    ids = materialise(ids, "wanted")
    if ids.count() * 8 <= small:
        found = packed_texts(docs.join(F.broadcast(ids), "doc_id", "left_semi"))
    else:
        found = packed_texts(docs).join(ids, "doc_id", "left_semi")
    return found.groupBy("doc_id").agg(F.max("packed").alias("packed"))


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int, parts: int, group: int = 256) -> DataFrame:
    """The pairs (a, b) with shared and joined (sizes of intersection and union of their sets), only_a (shingles of a that
    b lacks), extra (those of b that a lacks) and linked.

    Pairs are grouped by a in lots of at most about ``group``, so that the text of a travels once for each lot, and each
    pair's b once.
    """
    lots = pairs.withColumn("lot", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("n_a") / group)).cast("int")))
    hubs = lots.select("a", "lot").distinct().join(texts, F.col("a") == F.col("doc_id")).select("a", "lot", F.lit(None).cast("long").alias("b"), "packed")
    rest = lots.select("a", "lot", "b").join(texts, F.col("b") == F.col("doc_id")).select("a", "lot", "b", "packed")
    rows = hubs.unionByName(rest).repartition(parts, "a", "lot").sortWithinPartitions("a", "lot", F.asc_nulls_first("b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, of, hub = zstandard.ZstdDecompressor(), None, np.zeros(0, np.uint64)
        for whole in batches:
            for batch in rows_of(iter([whole]), 1000):
                out: list[tuple] = []
                for a, lot, b, packed in zip(*(batch.column(c).to_pylist() for c in ("a", "lot", "b", "packed")), strict=True):
                    hashes = shingle_hashes(unpack.decompress(packed), width)
                    if b is None:
                        of, hub = (a, lot), hashes
                        continue
                    assert of == (a, lot), "a lot starts with its hub"
                    extra = np.setdiff1d(hashes, hub, assume_unique=True)
                    shared = len(hashes) - len(extra)
                    out.append((a, b, shared, len(hub) + len(extra), len(hub) - shared, extra.astype(np.int64)))
                columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(5)] + [pa.array([x[5] for x in out], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "shared", "joined", "only_a", "extra"])

    schema = "a long, b long, shared long, joined long, only_a long, extra array<long>"
    return rows.mapInArrow(giving_back(check), schema).withColumn("linked", F.col("shared") * 100 >= F.col("joined") * percent)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger node u has one edge (u, v) and no node is both u and v."""
    roles = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    return roles.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c > 1 or (c > 0 and p > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every node of the edges (a, b): c is the smallest node that it can reach."""
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = materialise(small.filter("u > v").distinct(), "edges")
        discard(now)
        now = after
    return now.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(now.select("v", F.col("v").alias("c")).distinct())


def prefixes(around: DataFrame, percent: int) -> DataFrame:
    """(hub, rep, size, shared, own, k, shingle): of the shingles that the hub lacks (own of them, by rarity the k-th) those
    in which a linked pair must meet.

    A member x that shares i shingles with the hub and links with a y of the group shares at least k others with it, k =
    max(1, t / (1 + t) * (|x| + least |y|) - i) unless their common shingles are all the hub's. Taken from the rarest on, the
    first n - k + 1 of x's n others hold one that y's have too; one that x has alone cannot be it.
    """
    low = F.greatest(F.col("least_size"), F.ceil(F.col("size") * percent / 100))
    need = F.ceil((F.col("size") + low) * percent / (100 + percent)) - F.col("shared")
    rows = around.withColumn("most", F.size("extra") - F.greatest(F.lit(1), need) + 1).filter("most > 0")
    rows = rows.select("hub", "rep", "size", "shared", F.size("extra").alias("own"), "most", F.explode("extra").alias("shingle"))
    counted = rows.join(rows.groupBy("hub", "shingle").agg(F.count("*").alias("n")), ["hub", "shingle"])
    rank = F.row_number().over(Window.partitionBy("hub", "rep").orderBy("n", "shingle"))
    return counted.withColumn("k", rank).filter("k <= most and n > 1").select("hub", "rep", "size", "shared", "own", "k", "shingle")


def second_texts(docs: DataFrame) -> DataFrame | None:
    """(doc_id, h, alias): for each further text, by its hash, of a doc_id that stands at different texts, an id of its own.

    These are beyond 2^62 and so larger than the doc_id that they are linked to.
    """
    hashed = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    first = hashed.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi")
    first = materialise(first, "several")
    if first.isEmpty():
        return None
    alias = F.xxhash64("doc_id", "h").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    return materialise(hashed.join(first, "doc_id").filter("h > lo").select("doc_id", "h", alias.alias("alias")).distinct(), "aliases")


def same_documents(more: DataFrame, known: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes of the texts of one doc_id; a text without words stands for itself."""
    reps = known.join(classes, "set_hash").select(F.col("doc_id").alias("id"), "rep")
    pairs = more.select("doc_id", "alias").join(reps, F.col("doc_id") == F.col("id"), "left").select("alias", F.coalesce("rep", "doc_id").alias("a"))
    pairs = pairs.join(reps, F.col("alias") == F.col("id"), "left").select("a", F.coalesce("rep", "alias").alias("b"))
    return pairs.filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = 22, rows: int = 3, wave: int = 1024, text_ids: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document; text_ids: equal ids always have equal texts."""
    parts = shuffle_width(docs)
    docs = docs.select(integer_id(docs).alias("doc_id"), F.col("text").cast("string").alias("text"))
    more = None if text_ids else second_texts(docs)
    if more is not None:
        named = docs.withColumn("h", F.xxhash64("text")).join(more, ["doc_id", "h"], "left")
        docs = named.select(F.coalesce("alias", "doc_id").alias("doc_id"), "text")

    signed = materialise(signatures(docs, width, bands, rows), "signatures")
    known = signed.filter("set_hash is not null and doc_id is not null")
    classes = known.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.max("keys").alias("keys"))
    own = None if more is None else materialise(same_documents(more, known, classes), "own")

    def linked(pairs: DataFrame) -> DataFrame:
        edges = pairs.filter("linked").select("a", "b")
        return edges if own is None else edges.unionByName(own)

    keyed = classes.select("rep", F.explode("keys").alias("key"))
    shared = materialise(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"), "keyed")
    known_by = shared.groupBy("rep").agg(F.sum("n").alias("score"))
    hubs = shared.join(known_by, "rep").groupBy("key").agg(F.max_by("rep", F.struct("score", -F.col("rep"))).alias("hub"))
    members = materialise(shared.join(hubs, "key").select("hub", "rep").distinct(), "members")
    discard(shared)
    texts = materialise(texts_of(docs, members.select(F.col("rep").alias("doc_id")).distinct()), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        n_a = pairs.groupBy("a").agg(F.count("*").alias("n_a"))
        return materialise(confirm(pairs.join(n_a, "a"), texts, width, percent, parts), "checked")

    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "linked"]
    near = confirmed(members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    checked = near.select(*ordered)
    comp = materialise(components(linked(checked)), "components")

    def placed(df: DataFrame) -> DataFrame:
        return df.join(comp, F.col("rep") == F.col("v"), "left").select(*df.columns, F.coalesce("c", "rep").alias("c"))

    # Groups that still have several components; every member has been compared with the hub.
    at = placed(members)
    split = at.groupBy("hub").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select(F.col("hub").alias("a"))
    around = near.join(split, "a", "left_semi")
    around = around.select(F.col("a").alias("hub"), F.col("b").alias("rep"), "shared", (F.col("joined") - F.col("only_a")).alias("size"), "linked", "extra")
    around = materialise(around.join(around.groupBy("hub").agg(F.min("size").alias("least_size")), "hub"), "around")
    group, sized = ["hub", "shingle"], around.select("hub", "rep", "shared", "size", "linked")
    rare = materialise(prefixes(around, percent), "extra")
    fits = f"x.size * 100 >= y.size * {percent} and y.size * 100 >= x.size * {percent}"
    pair = [F.expr(f"{f}(x.{c}, y.{c})").alias(n) for f, c, n in (("least", "rep", "a"), ("greatest", "rep", "b"), ("least", "c", "c1"), ("greatest", "c", "c2"))]
    while True:
        # Pairs with a common shingle that their hub lacks; never two of the main component of the shingle.
        at = placed(rare)
        sizes = at.groupBy(*group, "c").agg(F.count("*").alias("n")).groupBy(*group).agg(F.count("*").alias("k"), F.max_by("c", "n").alias("main"))
        x = at.join(sizes.filter("k > 1").select(*group, "main"), group).filter("c <> main").alias("x")
        # If it is the first that they share, they share no more than follow it in both, and the hub's.
        room = f"least(x.own - x.k, y.own - y.k) + 1 + least(x.shared, y.shared) >= (x.size + y.size) * {percent} / {100 + percent}"
        pairs = x.join(at.alias("y"), F.expr(f"x.hub = y.hub and x.shingle = y.shingle and x.c <> y.c and {fits} and {room}")).select(*pair)
        # Pairs without one, of which x is far from the hub: y must be small enough.
        at = placed(sized)
        room = f"y.size * {percent} <= x.shared * {100 + percent} - x.size * {percent}"
        x, y = at.filter("not linked").alias("x"), at.select("hub", "size").distinct().alias("y")
        reach = x.join(y, F.expr(f"x.hub = y.hub and {fits} and {room}")).select("x.*", F.col("y.size").alias("other")).alias("x")
        also = f"(y.linked or x.size * {percent} <= y.shared * {100 + percent} - y.size * {percent})"
        small = reach.join(at.alias("y"), F.expr(f"x.hub = y.hub and x.other = y.size and x.c <> y.c and {also}")).select(*pair)
        pairs = pairs.unionByName(small).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
        number = F.row_number().over(Window.partitionBy("c1", "c2").orderBy(F.xxhash64("a", "b"), "a", "b"))
        some = materialise(pairs.withColumn("k", number).filter(F.col("k") <= wave).select("a", "b", "k"), "wave")
        if some.isEmpty():
            break
        whole = some.filter(F.col("k") == wave).isEmpty()  # then no pair has been left for another wave
        checked, wave = materialise(checked.unionByName(confirmed(some.select("a", "b")).select("a", "b", "linked")), "checked"), wave * 4
        discard(comp)
        comp = materialise(components(linked(checked)), "components")
        if whole:
            break
    reps = classes.select("set_hash", "rep").join(comp, F.col("rep") == F.col("v"), "left").select("set_hash", F.coalesce("c", "rep").alias("c"))
    out = signed.drop("keys").join(reps, "set_hash", "left")
    if more is not None:  # texts without words have no class, and so no component but their document's
        alone = comp.select(F.col("v").alias("doc_id"), F.col("c").alias("own"))
        names = more.select(F.col("alias").alias("doc_id"), F.col("doc_id").alias("real"))
        out = out.join(alone, "doc_id", "left").join(names, "doc_id", "left")
        out = out.withColumn("c", F.coalesce("c", "own", "real")).withColumn("doc_id", F.coalesce("real", "doc_id")).drop("own", "real")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("c", "doc_id"))
    for old in (texts, members, around, rare):
        discard(old)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each group; all columns stay as they are."""
    gone = materialise(near_duplicates(docs, **options).filter("not kept").select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
