"""Checks of id-list files: lines of an id, a tab and a comma-separated list.

Every check is a frame of offenders (check, severity, line_id, detail), so a report over large files stays distributed;
``summarise`` gives totals and the first five of each, sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import path_exists, read_ids, read_match_targets, split_id_list

MATCH_HEADER = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_HEADER = ("source1_entity_id", "candidate_entity_ids")


def _found(rows: DataFrame, check: str, line_id: str, detail: str, severity: str = "error") -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col(line_id).cast("string").alias("line_id"), F.expr(detail).cast("string").alias("detail"))


def id_rows(lines: DataFrame) -> DataFrame:
    """Non-blank lines with a tab: id and the raw list (empty text: no ids). Only the first tab separates."""
    rows = lines.filter(F.trim("value") != "").filter(F.instr("value", "\t") > 0)
    ids = F.when(F.col("ids") == "", F.array().cast("array<string>")).otherwise(F.split("ids", ","))
    return rows.withColumn("list", ids)


def without_tab(lines: DataFrame) -> DataFrame:
    return _found(lines.filter((F.trim("value") != "") & (F.instr("value", "\t") == 0)), "no_tab", "value", "value")


def duplicate_rows(rows: DataFrame) -> DataFrame:
    return _found(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate_row", "id", "n")


def repeated_ids(rows: DataFrame) -> DataFrame:
    return _found(rows.filter("size(list) <> size(array_distinct(list))"), "repeated_id", "id", "size(list) - size(array_distinct(list))")


def members(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.explode("list").alias("member"))


def own_source_ids(rows: DataFrame) -> DataFrame:
    return _found(members(rows).filter("startswith(member, 'S1-')"), "own_source_id", "id", "member")


def bad_prefixes(rows: DataFrame) -> DataFrame:
    return _found(members(rows).filter("not startswith(member, 'S1-') and not startswith(member, 'S2-') and not startswith(member, 'S3-')"), "bad_prefix", "id", "member")


def unknown_ids(rows: DataFrame, valid: DataFrame) -> DataFrame:
    other = members(rows).filter("startswith(member, 'S2-') or startswith(member, 'S3-')")
    return _found(other.join(valid.select(F.col("entity_id").alias("member")), "member", "left_anti"), "unknown_id", "id", "member")


def missing_rows(rows: DataFrame, required: DataFrame) -> DataFrame:
    return _found(required.select(F.col("entity_id").alias("id")).join(rows.select("id"), "id", "left_anti"), "missing_row", "id", "id")


def extra_rows(rows: DataFrame, required: DataFrame) -> DataFrame:
    return _found(rows.select("id").distinct().join(required.select(F.col("entity_id").alias("id")), "id", "left_anti"), "extra_row", "id", "id")


def last_lists(rows: DataFrame) -> DataFrame:
    """One list for each id: of several lines the last, by the column line where there is one."""
    order = F.col("line") if "line" in rows.columns else F.lit(0)
    return rows.groupBy("id").agg(F.max_by("list", order).alias("list"))


def outside_candidates(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that are no candidates of their record; a warning."""
    m, c = last_lists(matching), last_lists(candidates).withColumnRenamed("list", "cands")
    both = m.join(c, "id", "left").withColumn("out", F.expr("array_except(list, coalesce(cands, cast(array() as array<string>)))"))
    return _found(both.filter("size(out) > 0"), "outside_candidates", "id", "array_join(array_sort(out), ',')", "warning")


def check_lists(lines: DataFrame, required: DataFrame | None = None, valid: DataFrame | None = None) -> DataFrame:
    """All row checks of one file's lines (value, id, ids), header excluded."""
    rows = id_rows(lines)
    found = [without_tab(lines), duplicate_rows(rows), repeated_ids(rows), own_source_ids(rows), bad_prefixes(rows)]
    if valid is not None:
        found.append(unknown_ids(rows, valid))
    if required is not None:
        found += [missing_rows(rows, required), extra_rows(rows, required)]
    return reduce(DataFrame.unionByName, found)


def list_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.size("list") == 0).alias("n_empty"), F.count_if(F.size("list") > 0).alias("n_nonempty"))


def summarise(found: DataFrame, n: int = 5) -> DataFrame:
    """(check, severity, total, sample): the sample has the first n offenders by id, joined."""
    from pyspark.sql import Window

    # The sample is picked before gathering, so no check's offenders meet in one task.
    totals = found.groupBy("check", "severity").agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy("check", "severity").orderBy("line_id", "detail"))
    first = found.withColumn("_n", rank).filter(F.col("_n") <= n).groupBy("check", "severity").agg(F.array_join(F.array_sort(F.collect_list("line_id")), ",").alias("sample"))
    return totals.join(first, ["check", "severity"])


def check_header(line: str | None, expected: tuple[str, str]) -> str | None:
    """What is wrong with a header line, if anything."""
    if line is None or not line.strip():
        return "the file is empty"
    if "\t" not in line and "," in line:
        return "the header is separated by commas"
    if tuple(p.strip().lower() for p in line.split("\t")) != expected:
        return f"the header is not {expected[0]}, tab, {expected[1]}"
    return None


def read_lines(spark: SparkSession, path: str) -> tuple[str | None, DataFrame]:
    """The header, and the other lines with line (order within the file), value, id and ids.

    A file is one stream of lines in which the header comes first, so it is read by one task; ids are checked apart.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))
    first = text.orderBy("line").limit(1).collect()
    if not first:
        return None, split_id_list(text)
    return first[0].value, split_id_list(text.filter(F.col("line") > first[0].line))


def validate_submission(spark: SparkSession, matching: str, candidate: str | None, test_dir: str, check_ids: bool = False) -> tuple[list[str], list[str], DataFrame | None]:
    """Fatal errors, warnings, and the offenders of all checks over both files."""
    errors, warnings, frames, kept = [], [], [], {}
    source1 = f"{test_dir}/test_source1.tsv"
    if not path_exists(spark, source1):
        return [f"{source1} is missing"], warnings, None
    required, valid = read_ids(spark, source1), None
    if check_ids:
        valid, more = read_match_targets(spark, [f"{test_dir}/test_source{n}.tsv" for n in (2, 3)])
        warnings += more
    else:
        warnings.append("ids are not checked against the sources")
    for path, header in ((matching, MATCH_HEADER), (candidate, CANDIDATE_HEADER)):
        if path is None or not path_exists(spark, path):
            (errors if header is MATCH_HEADER else warnings).append(f"{path} is missing")
            continue
        try:
            first, lines = read_lines(spark, path)
            if not spark.read.text(path).filter("not is_valid_utf8(value)").isEmpty():
                errors.append(f"{path} is not UTF-8")
                continue
        except Exception as e:  # an unreadable file fails the check, not the run
            errors.append(f"{path} can't be read: {type(e).__name__}")
            continue
        if wrong := check_header(first, header):
            errors.append(f"{path}: {wrong}")
            continue
        kept[header] = id_rows(lines)
        frames.append(check_lists(lines, required, valid))
    if len(kept) == 2:
        frames.append(outside_candidates(kept[MATCH_HEADER], kept[CANDIDATE_HEADER]))
    return errors, warnings, reduce(DataFrame.unionByName, frames) if frames else None
