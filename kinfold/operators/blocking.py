"""Candidate pairs by bounded equi-joins on several blocking keys, and their ranking by votes.

All key families are one declarative list; a side is scanned once and its keys exploded. Each posting list (the pool rows
of one key) is cut to the family's bound by a rank that Spark limits on the map side, gathered into an array of at most
that many ids, and joined to the other side's keys, so the shuffle has a row for each (record, key) and one for each key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as X


@dataclass(frozen=True)
class KeySpec:
    """One key family: its expression over slim records (an array if multi) and the bounds of its posting lists."""

    id: str
    expr: Callable[[], Column] = field(compare=False)
    max_per_block: int | None = None  # None: the candidate cap
    block_size_limit: int = 500
    multi: bool = False

    def bound(self, cap: int) -> int:
        return min(cap if self.max_per_block is None else self.max_per_block, self.block_size_limit)


def _name() -> Column:
    return F.col("normalized_name")


def _address() -> Column:
    return F.col("normalized_address")


def _country() -> Column:
    return F.trim("country")


DEFAULT_KEYS = (
    KeySpec("phon_pref3", lambda: X.composite(F.col("phonetic_key"), X.name_prefix(_name()))),
    KeySpec("sorted_token", lambda: F.col("sorted_token_key")),
    KeySpec("country_word1", lambda: X.composite(_country(), X.significant_words(_name())["w1"]), 30, 300),
    KeySpec("country_word2", lambda: X.composite(_country(), X.significant_words(_name())["w2"]), 20, 200),
    KeySpec("addr4_name3", lambda: X.composite(_country(), X.address_prefix(_address()), X.name_prefix(_name())), 25),
    KeySpec("country_phon", lambda: X.composite(_country(), F.col("phonetic_key")), 20, 50),
    KeySpec("addr6", lambda: X.composite(_country(), X.address_prefix(_address(), 6))),
    KeySpec("addr_tokens", lambda: X.address_tokens(_address()), 10_000, 10_000, multi=True),
    KeySpec("skeleton", lambda: X.composite(_country(), X.consonant_skeleton(_name()))),
)


def emit_keys(records: DataFrame, keys: tuple[KeySpec, ...], *extra: str) -> DataFrame:
    """(entity_id, extra, key_id, key) for every valid key; keys are trimmed."""
    def family(k: KeySpec) -> Column:
        values = k.expr() if k.multi else F.array(k.expr())
        return F.transform(values, lambda v: F.struct(F.lit(k.id).alias("key_id"), F.trim(v).alias("key"), F.lit(k.multi).alias("multi")))

    out = records.select("entity_id", *extra, F.explode(F.concat(*map(family, keys))).alias("k")).select("entity_id", *extra, "k.key_id", "k.key", "k.multi")
    return out.filter(F.col("multi") | X.valid_key(F.col("key"))).drop("multi")


def postings(pool: DataFrame, keys: tuple[KeySpec, ...], cap: int, truncation: str = "hash") -> DataFrame:
    """(key_id, key, ids): each key's pool ids, cut to the family's bound.

    truncation: "hash" keeps the rows with the smallest hash of (entity_id, key), an even sample that does not depend on
    the order of rows; "ordinal" keeps the first by source and row_ord (entity_id where there is none).

    Spark limits groups before the shuffle up to a bound of its own (1,000 by default), so families beyond it have a window
    to themselves.
    """
    most = int(pool.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    near = tuple(k for k in keys if k.bound(cap) <= most)
    parts = [part for part in (near, tuple(k for k in keys if k not in near)) if part]
    return reduce(DataFrame.unionByName, (_cut(pool, part, cap, truncation == "ordinal") for part in parts))


def _cut(pool: DataFrame, keys: tuple[KeySpec, ...], cap: int, ordinal: bool) -> DataFrame:
    order_by = "row_ord" if "row_ord" in pool.columns else "entity_id"
    rows = emit_keys(pool.withColumn("_ord", F.struct(F.substring("entity_id", 1, 2), F.col(order_by))), keys, "_ord") if ordinal else emit_keys(pool, keys)
    first = [F.col("_ord")] if ordinal else [F.md5(F.concat_ws("|", "entity_id", "key"))]
    window = Window.partitionBy("key_id", "key").orderBy(*first, "entity_id")
    bounds = {k.id: k.bound(cap) for k in keys}
    bound = F.coalesce(*(F.when(F.col("key_id") == k, n) for k, n in bounds.items()))
    # The literal bound lets Spark limit the groups before the shuffle, the other one is each family's own.
    cut = rows.withColumn("_n", F.row_number().over(window)).filter((F.col("_n") <= max(bounds.values())) & (F.col("_n") <= bound))
    return cut.groupBy("key_id", "key").agg(F.collect_list("entity_id").alias("ids"))


def block(s1: DataFrame, pool: DataFrame, keys: tuple[KeySpec, ...] = DEFAULT_KEYS, cap: int = 1000, truncation: str = "hash") -> DataFrame:
    """(s1_id, cand_id, key_id): one row for each vote."""
    own = emit_keys(s1, keys).withColumnRenamed("entity_id", "s1_id")
    return own.join(postings(pool, keys, cap, truncation), ["key_id", "key"]).select("s1_id", F.explode("ids").alias("cand_id"), "key_id")


def count_votes(hits: DataFrame) -> DataFrame:
    return hits.filter(~F.col("cand_id").startswith("S1-")).groupBy("s1_id", "cand_id").agg(F.count("*").alias("votes"))


def rank_votes(votes: DataFrame, cap: int) -> DataFrame:
    """The cap candidates of each record with most votes, ties by id, with their rank."""
    window = Window.partitionBy("s1_id").orderBy(F.desc("votes"), "cand_id")
    return votes.withColumn("rnk", F.row_number().over(window)).filter(F.col("rnk") <= cap)


def counted(ranked: DataFrame) -> DataFrame:
    """(s1_id, n): the candidates of each record that has any."""
    return ranked.groupBy("s1_id").agg(F.count("*").alias("n"))


def weak_coverage(s1: DataFrame, ranked: DataFrame, threshold: int = 100) -> DataFrame:
    """(s1_id, n_candidates) of records with fewer candidates than the threshold."""
    return weak_of_counts(s1, counted(ranked), threshold)


def weak_of_counts(s1: DataFrame, counts: DataFrame, threshold: int = 100) -> DataFrame:
    out = s1.select(F.col("entity_id").alias("s1_id")).join(counts, "s1_id", "left")
    return out.select("s1_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates")).filter(F.col("n_candidates") < threshold)


def candidate_lists(s1: DataFrame, ranked: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_ids): one row for each record, the list in order of rank."""
    lists = ranked.groupBy("s1_id").agg(F.sort_array(F.collect_list(F.struct("rnk", "cand_id"))).alias("l"))
    out = s1.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left")
    ids = F.coalesce(F.col("l.cand_id"), F.array().cast("array<string>"))
    return out.select(F.col("s1_id").alias("source1_entity_id"), F.array_distinct(ids).alias("candidate_entity_ids"))


def coverage_report(s1: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row: records, candidates, records with and without candidates, the most and the mean for a record."""
    return coverage_of_counts(s1, counted(ranked))


def coverage_of_counts(s1: DataFrame, counts: DataFrame) -> DataFrame:
    each = s1.select(F.col("entity_id").alias("s1_id")).join(counts, "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return each.agg(
        F.count("*").alias("n_records"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_candidates"), F.count_if(F.col("n") > 0).alias("n_nonempty"),
        F.count_if(F.col("n") == 0).alias("n_empty"), F.coalesce(F.max("n"), F.lit(0)).alias("most"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"),
    )
