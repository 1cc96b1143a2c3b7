"""Commands: ``python -m kinfold.jobs normalize|block|validate``. The exit code is 0 if all went well and passed."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.normalize import normalize_records
from .operators import blocking, evaluation, profiling, validation
from .plans.candidates import FULL_RUN, generate_candidates
from .sources import tables
from .sources.staging import materialise


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinfold.jobs", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("normalize", help="write a source with its normalised columns")
    one.add_argument("source")
    one.add_argument("target")
    one = jobs.add_parser("block", help="write candidate lists for the first source")
    for name in ("source1", "source2", "source3", "root"):
        one.add_argument(name)
    one.add_argument("--truth", help="known matches; recall is measured against the target")
    one.add_argument("--sample", type=int, help="rows of the first source")
    one.add_argument("--sample-seed", type=int, default=42)
    one.add_argument("--pool-limit", type=int, help="rows of each of the other sources")
    one.add_argument("--skip-fuzzy-fallback", action="store_true")
    one.add_argument("--target", type=float, default=0.95)
    one = jobs.add_parser("validate", help="check id-list files")
    one.add_argument("matching")
    one.add_argument("--candidate")
    one.add_argument("--test-dir", required=True)
    one.add_argument("--check-ids", action="store_true")
    return top


def normalize(spark: SparkSession, args: argparse.Namespace) -> int:
    tables.write_table(normalize_records(tables.read_source(spark, args.source)).select(*tables.NORMALIZED_COLUMNS), args.target)
    return 0


def block(spark: SparkSession, args: argparse.Namespace) -> int:
    """Candidate lists in the order of the first source; with known matches, the log and what was missed."""
    first = tables.read_source(spark, args.source1, row_ord=True)
    if args.sample:
        first = profiling.seeded_sample(first, args.sample, args.sample_seed)
    first = materialise(first, "source1")
    others = [tables.read_source(spark, path) for path in (args.source2, args.source3)]
    if args.pool_limit:
        others = [tables.first_rows(df, args.pool_limit) for df in others]
    s1 = materialise(normalize_records(first.drop("row_ord")), "s1")
    s2, s3 = (materialise(normalize_records(df), "pool") for df in others)
    config = dataclasses.replace(FULL_RUN, run_fuzzy_fallback=not args.skip_fuzzy_fallback)
    cands = materialise(generate_candidates(s1, s2, s3, config), "candidates")
    lists = blocking.candidate_lists(s1, cands).join(first.select(F.col("entity_id").alias("source1_entity_id"), "row_ord"), "source1_entity_id")
    tables.write_lists(lists, tables.output_path(args.root, args.sample), ("source1_entity_id", "candidate_entity_ids"))
    tables.report(blocking.coverage_report(s1, cands))
    if not args.truth:
        return 0
    truth, pool = tables.read_source(spark, args.truth), tables.slim(s2).unionByName(tables.slim(s3))
    metrics, detail = evaluation.recall_gate(cands, truth, s1, pool, args.target, f"{args.root}/logs/missed_pairs")
    tables.append_experiment(
        spark, f"{args.root}/logs/experiments", strategies="+".join(k.id for k in config.keys), tfidf_ngram_range="(1,3)", tfidf_k=config.tfidf_k, candidate_cap=config.candidate_cap,
        candidate_recall=metrics["candidate_recall"], reduction_ratio=metrics["reduction_ratio"], avg_candidates=metrics["avg_candidates"], max_candidates=metrics["max_candidates"],
        notes=f"sample={args.sample}, seed={args.sample_seed}, pool limit={args.pool_limit}, fallback={config.run_fuzzy_fallback}",
    )
    if detail is not None:
        tables.report(detail)
    return 0 if metrics["passed"] else 1


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    errors, warnings, found = validation.validate_submission(spark, args.matching, args.candidate, args.test_dir, args.check_ids)
    for kind, lines in (("error", errors), ("warning", warnings)):
        for line in lines:
            print(f"{kind}: {line}")
    fatal = bool(errors)
    if found is not None:
        found = materialise(found, "offenders")
        tables.report(validation.summarise(found))
        fatal = fatal or not found.filter("severity = 'error'").isEmpty()
    return int(fatal)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return {"normalize": normalize, "block": block, "validate": validate}[args.job](spark or SparkSession.builder.appName("kinfold").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
