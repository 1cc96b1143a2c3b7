"""Quality of candidate lists and of final matches against known pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import parse_matches


def truth_pairs(truth: DataFrame, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows in scope as s1_id, distinct pairs s1_id, true_id) of a table source1_entity_id, matched_entity_ids."""
    rows = truth.select(F.col("source1_entity_id").alias("s1_id"), parse_matches(F.col("matched_entity_ids")).alias("ids"))
    if scope is not None:
        rows = rows.join(scope.select(F.col("entity_id").alias("s1_id")).distinct(), "s1_id", "left_semi")
    return rows.select("s1_id"), rows.select("s1_id", F.explode("ids").alias("true_id")).distinct()


def missed_pairs(cands: DataFrame, truth: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    _, pairs = truth_pairs(truth, scope)
    return pairs.join(cands.select("s1_id", F.col("cand_id").alias("true_id")), ["s1_id", "true_id"], "left_anti")


def evaluate_blocking(cands: DataFrame, truth: DataFrame, s1: DataFrame, pool: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One row of metrics, and the missed pairs.

    Recall is micro: captured over true pairs, 0 without any. Candidate counts are over truth rows in scope.
    reduction_ratio is the surviving fraction, candidates over all pairs of s1 and pool.
    """
    rows, pairs = truth_pairs(truth, s1)
    keyed = cands.select("s1_id", F.col("cand_id").alias("true_id")).distinct()
    hits = pairs.join(keyed.withColumn("hit", F.lit(1)), ["s1_id", "true_id"], "left").agg(F.count("*").alias("true_pairs"), F.count("hit").alias("captured"))
    counts = keyed.groupBy("s1_id").agg(F.count("*").alias("n"))
    volume = rows.join(counts, "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n")).agg(
        F.count("*").alias("n_evaluated"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_candidates"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_candidates"), F.coalesce(F.max("n"), F.lit(0)).alias("max_candidates"),
        F.count_if(F.col("n") == 0).alias("zero_candidates"),
    )
    out = hits.join(volume)  # one row each
    out = out.withColumn("missed", F.col("true_pairs") - F.col("captured")).withColumn("candidate_recall", F.coalesce(F.try_divide("captured", "true_pairs"), F.lit(0.0)))
    if pool is not None:
        out = out.join(reduction_ratio(out.select("total_candidates"), s1, pool).select("reduction_ratio"))
    return out, missed_pairs(cands, truth, s1)


def recall_gate(cands: DataFrame, truth: DataFrame, s1: DataFrame, pool: DataFrame, target: float = 0.95, json_path: str | None = None, n: int = 30) -> tuple[dict, DataFrame | None]:
    """The metrics as a dict with ``passed``, and, where recall is below the target, the first n missed pairs in detail.

    They are then also written as JSON lines below json_path (a folder), if it is given.
    """
    out, missed = evaluate_blocking(cands, truth, s1, pool)
    metrics = out.first().asDict()
    metrics["passed"] = metrics["candidate_recall"] >= target
    if metrics["passed"]:
        return metrics, None
    detail = missed_detail(missed, s1, pool, n)
    if json_path is not None:
        detail.orderBy("s1_id", "true_id").coalesce(1).write.mode("overwrite").json(json_path)
    return metrics, detail


def reduction_ratio(total: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """total has one row with total_candidates; the result adds both sizes and the surviving fraction."""
    sizes = s1.agg(F.count("*").alias("n_s1")).join(pool.agg(F.count("*").alias("n_pool")))
    ratio = F.coalesce(F.try_divide(F.col("total_candidates"), F.col("n_s1") * F.col("n_pool")), F.lit(0.0))
    return total.join(sizes).withColumn("reduction_ratio", ratio)


def missed_detail(missed: DataFrame, s1: DataFrame, pool: DataFrame, n: int | None = 30) -> DataFrame:
    """Missed pairs with the names, addresses and countries of both sides; 'N/A' where a side is unknown."""
    first = missed if n is None else missed.orderBy("s1_id", "true_id").limit(n)

    def side(df: DataFrame, key: str, prefix: str) -> DataFrame:
        return df.select(F.col("entity_id").alias(key), *(F.col(c).alias(f"{prefix}_{c}") for c in ("normalized_name", "normalized_address", "country")))

    out = first.join(side(s1, "s1_id", "s1"), "s1_id", "left").join(side(pool, "true_id", "true"), "true_id", "left")
    return out.select("s1_id", "true_id", *(F.coalesce(c, F.lit("N/A")).alias(c) for c in out.columns if c not in ("s1_id", "true_id")))


def f05_by_record(pred: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """(s1_id, precision, recall, f05) of each record; pred has s1_id and cand_id.

    A record without true matches has 1 for an empty prediction and 0 otherwise; no hit at all is 0.
    """
    _, pairs = truth_pairs(truth)
    found = pred.select("s1_id", F.col("cand_id").alias("true_id")).distinct().withColumn("p", F.lit(1))
    both = found.join(pairs.withColumn("t", F.lit(1)), ["s1_id", "true_id"], "full")
    counts = both.groupBy("s1_id").agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.count(F.expr("p + t")).alias("tp"))
    each = s1.select(F.col("entity_id").alias("s1_id")).join(counts, "s1_id", "left").fillna(0, ["np", "nt", "tp"])
    p, r = F.coalesce(F.try_divide("tp", "np"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "nt"), F.lit(0.0))
    score = F.coalesce(F.try_divide(1.25 * p * r, 0.25 * p + r), F.lit(0.0))
    score = F.when(F.col("nt") == 0, F.when(F.col("np") == 0, 1.0).otherwise(0.0)).otherwise(score)
    return each.select("s1_id", p.alias("precision"), r.alias("recall"), score.alias("f05"))


def f05_macro(pred: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    return f05_by_record(pred, truth, s1).agg(F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"), F.count("*").alias("n_records"))
