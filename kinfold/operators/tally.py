"""Votes of whole candidate sets without a row for each vote: the same results as block, count_votes and rank_votes.

Records with equal keys are one unit. Units are dealt to blocks by hash; a block gets each posting list that any of its
units needs once, counts votes in NumPy and returns a row for each unit, so that what is shuffled follows the posting
lists of a block and not the votes. The number of blocks follows the number of votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import materialise
from .blocking import DEFAULT_KEYS, KeySpec, emit_keys, postings

#: Votes of a block, at most on average; votes counted at once, beyond those of one unit; records of one unit at most.
#: A step takes some 150 bytes for each vote, and its lists make one batch, of which the executor holds copies.
BLOCK_VOTES, STEP_VOTES, UNIT_RECORDS = 1 << 25, 1 << 18, 256
#: Rows of a batch of pairs, at most beyond those of one record.
PAIR_ROWS = 1 << 18
#: So many blocks keep the cores busy where there are few votes. Each block gets lists of its own, so more are not free.
BUSY_BLOCKS, BUSY_VOTES = 32, 1 << 20


@dataclass(frozen=True)
class Staged:
    """units: (unit, members, keys); posted: (key_id, key, ids, n_ids: distinct ones); weights: (unit, votes, largest: most
    distinct ids of a list), of units with candidates. All are in the shared folder."""

    units: DataFrame
    posted: DataFrame
    weights: DataFrame
    n_blocks: int


def stage(s1: DataFrame, pool: DataFrame, keys: tuple[KeySpec, ...] = DEFAULT_KEYS, cap: int = 1000, truncation: str = "hash") -> Staged:
    """Units of s1 and bounded posting lists of the pool."""
    posted = postings(pool, keys, cap, truncation).withColumn("ids", F.filter("ids", lambda i: ~i.startswith("S1-")))
    return with_postings(s1, materialise(posted.withColumn("n_ids", F.size(F.array_distinct("ids"))), "posted"), keys)


def with_postings(s1: DataFrame, posted: DataFrame, keys: tuple[KeySpec, ...] = DEFAULT_KEYS) -> Staged:
    """Units of s1 over posting lists that were staged before."""
    sets = emit_keys(s1, keys).groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("key_id", "key"))).alias("keys"))
    groups = sets.groupBy("keys").agg(F.collect_list("entity_id").alias("all"))
    starts = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / UNIT_RECORDS).cast("int"))
    units = groups.withColumn("at", F.explode(starts)).select(F.slice("all", F.col("at") * UNIT_RECORDS + 1, UNIT_RECORDS).alias("members"), "keys")
    units = materialise(units.withColumn("unit", F.monotonically_increasing_id()), "units")
    sizes = posted.filter("n_ids > 0").select("key_id", "key", F.size("ids").alias("n"), "n_ids")
    needed = units.select("unit", F.explode("keys").alias("k")).select("unit", "k.*").join(sizes, ["key_id", "key"])
    weights = materialise(needed.groupBy("unit").agg(F.sum("n").alias("votes"), F.max("n_ids").alias("largest")), "weights")
    return Staged(units, posted, weights, _blocks(weights))


def _blocks(weights: DataFrame) -> int:
    n = weights.agg(F.coalesce(F.sum("votes"), F.lit(0))).first()[0]
    width = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n // BLOCK_VOTES), min(width, BUSY_BLOCKS, n // BUSY_VOTES))


def _pairs(members: pa.ListArray, count: np.ndarray, places: np.ndarray, votes: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
    """(s1, cand, votes, rnk) of each member and candidate of units, whose candidates stand one unit after the other."""
    each = members.flatten()
    unit = np.repeat(np.arange(len(count)), pc.list_value_length(members).to_numpy())
    start, n = (np.cumsum(count) - count)[unit], count[unit]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(n) // PAIR_ROWS)) + 1, [len(n)]])
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        m = n[low:high]
        rnk = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        at = np.repeat(start[low:high], m) + rnk
        own = each.take(pa.array(np.repeat(np.arange(low, high), m)))
        yield pa.record_batch([own, names.take(pa.array(places[at])), pa.array(votes[at]), pa.array((rnk + 1).astype(np.int32))], names=["s1", "cand", "votes", "rnk"])


#: What a block returns: counts or lists of each unit, or a row for each record and candidate.
SCHEMAS = {"counts": "members array<string>, n long", "lists": "members array<string>, cands array<string>, votes array<long>", "pairs": "s1 string, cand string, votes long, rnk int"}


def _unit_rows(batches: Iterator[pa.RecordBatch], keep: int | None, form: str) -> Iterator[pa.RecordBatch]:
    """Of the rows of a block: what SCHEMAS says of units with candidates, in order of rank."""
    units, members, needed, n_units, sizes, coded = [], [], [], [], [], []
    for batch in batches:  # ids are kept as codes, so that the strings of a batch go with it
        own, lists = batch.filter(batch["own"]), batch.filter(pc.invert(batch["own"]))
        units.append(pc.list_flatten(own["units"]).to_numpy())
        members.append(own["ids"])
        needed.append(pc.list_flatten(lists["units"]).to_numpy())
        n_units.append(pc.list_value_length(lists["units"]).to_numpy())
        sizes.append(pc.list_value_length(lists["ids"]).to_numpy().astype(np.int64))
        coded.append(pc.list_flatten(lists["ids"]).dictionary_encode())
    if not any(map(len, sizes)):
        return
    units, needed, n_units, sizes = map(np.concatenate, (units, needed, n_units, sizes))
    order = np.argsort(units)
    members = pa.chunked_array(members).combine_chunks().take(pa.array(order))
    units = units[order]
    # Every posting list as places in the sorted ids of the block.
    coded = pa.chunked_array(coded).unify_dictionaries().chunks
    by_name = pc.sort_indices(coded[0].dictionary).to_numpy()
    names, place = coded[0].dictionary.take(pa.array(by_name)), np.empty(len(by_name), np.int32)
    place[by_name] = np.arange(len(by_name))
    posted = np.concatenate([place[c.indices.to_numpy()] for c in coded])
    del coded, place
    ends = np.cumsum(sizes)
    # Which list each unit needs, units in order.
    need = np.repeat(np.arange(len(sizes)), n_units)
    who = np.searchsorted(units, needed)
    order = np.argsort(who, kind="stable")
    who, need = who[order], need[order]
    hits, bits = sizes[need], max(1, int(len(names)).bit_length())
    step = np.cumsum(np.bincount(who, hits, len(units))).astype(np.int64) // STEP_VOTES
    for low, high in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1, [len(units)]])), strict=True):
        a, b = np.searchsorted(who, [low, high])
        n = hits[a:b]
        if not n.sum():
            continue
        at = np.repeat((ends - sizes)[need[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys = np.sort((np.repeat(who[a:b] - low, n) << bits) | posted[at])
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        votes, keys = np.diff(first, append=len(keys)), keys[first]
        rows = keys >> bits
        count = np.bincount(rows, minlength=high - low)
        some = np.flatnonzero(count)
        kept = count[some] if keep is None else np.minimum(count[some], keep)
        mine = members.take(pa.array(some + low))
        if form == "counts":
            yield pa.record_batch([mine, pa.array(kept)], names=["members", "n"])
            continue
        most = int(votes.max())
        tall = most.bit_length()
        keys = np.sort((rows << (bits + tall)) | ((most - votes) << bits) | (keys & ((1 << bits) - 1)))
        start = np.cumsum(count) - count
        if keep is not None and len(keys) > kept.sum():
            keys = keys[np.arange(len(keys)) - start[keys >> (bits + tall)] < keep]
        places, votes = keys & ((1 << bits) - 1), most - ((keys >> bits) & ((1 << tall) - 1))
        if form == "pairs":
            yield from _pairs(mine, kept, places, votes, names)
            continue
        offsets = pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32())
        cands = pa.ListArray.from_arrays(offsets, names.take(pa.array(places)))
        yield pa.record_batch([mine, cands, pa.ListArray.from_arrays(offsets, pa.array(votes))], names=["members", "cands", "votes"])


def _rows_of_block(keep: int | None, form: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _unit_rows(batches, keep, form)

    return run


def _by_unit(staged: Staged, keep: int | None, form: str) -> DataFrame:
    units = staged.units.withColumn("block", F.pmod(F.xxhash64("unit"), F.lit(staged.n_blocks)).cast("int"))
    needed = units.select("block", "unit", F.explode("keys").alias("k")).groupBy("block", "k.key_id", "k.key").agg(F.collect_list("unit").alias("units"))
    lists = needed.join(staged.posted, ["key_id", "key"]).select("block", F.lit(False).alias("own"), "units", "ids")
    rows = lists.unionByName(units.select("block", F.lit(True).alias("own"), F.array("unit").alias("units"), F.col("members").alias("ids")))
    return rows.groupBy("block").applyInArrow(_rows_of_block(keep, form), SCHEMAS[form])


def candidate_counts(staged: Staged, keep: int | None = None) -> DataFrame:
    """(s1_id, n) of records with candidates: how many, at most ``keep``.

    A unit with ``keep`` ids in a single list has as many candidates; only the others are counted.
    """
    if keep is None:
        rows = _by_unit(staged, None, "counts")
    else:
        open_ = staged.weights.filter(F.col("largest") < keep)
        settled = staged.units.join(staged.weights.filter(F.col("largest") >= keep), "unit", "left_semi")
        rows = _by_unit(replace(staged, units=staged.units.join(open_, "unit", "left_semi"), n_blocks=_blocks(open_)), keep, "counts")
        rows = rows.unionByName(settled.select("members", F.lit(keep).cast("long").alias("n")))
    return rows.select(F.explode("members").alias("s1_id"), "n")


def covered(staged: Staged) -> DataFrame:
    """(s1_id) of records with candidates, found without counting any."""
    return staged.units.join(staged.weights, "unit", "left_semi").select(F.explode("members").alias("s1_id")).distinct()


def candidate_lists(staged: Staged, keep: int | None = None) -> DataFrame:
    """(s1_id, cands, votes) of records with candidates, both arrays in order of rank: most votes first, ties by id."""
    return _by_unit(staged, keep, "lists").select(F.explode("members").alias("s1_id"), "cands", "votes")


def ranked(staged: Staged, keep: int | None = None) -> DataFrame:
    """(s1_id, cand_id, votes, rnk), as rank_votes returns them."""
    return _by_unit(staged, keep, "pairs").toDF("s1_id", "cand_id", "votes", "rnk")
