"""Readers and writers of tab-separated record and id-list files, and of the experiment log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
NORMALIZED_COLUMNS = [
    "entity_id", "business_name", "normalized_name", "business_address", "normalized_address", "phonetic_key",
    "sorted_token_key", "country",
]
SLIM_COLUMNS = ["entity_id", "country", "normalized_name", "normalized_address", "phonetic_key", "sorted_token_key"]

#: Words that stand for a missing value in text files.
NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]

EXPERIMENT_COLUMNS = [
    "experiment_id", "strategies", "tfidf_ngram_range", "tfidf_k", "candidate_cap", "candidate_recall", "reduction_ratio",
    "avg_candidates", "max_candidates", "notes",
]


def blank_missing(df: DataFrame, na_words: list[str] | None = None) -> DataFrame:
    """All columns as text, with nulls and missing-value words as ''."""
    words = NA_WORDS if na_words is None else na_words
    text = [F.col(f"`{c}`").cast("string") for c in df.columns]
    return df.select(*(F.when(t.isNull() | t.isin(words), F.lit("")).otherwise(t).alias(c) for t, c in zip(text, df.columns, strict=True)))


def read_source(
    spark: SparkSession, path: str, columns: list[str] | None = None, na_words: list[str] | None = None, multi_line: bool = True, row_ord: bool = False
) -> DataFrame:
    """A tab-separated table with a header, all columns as text. A file without quoted line ends can be read split
    (``multi_line=False``), which spreads a large one over many tasks. row_ord adds a column that grows with the order of rows."""
    head = spark.read.option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').option("inferSchema", False)
    names = head.csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in names])
    df = head.option("multiLine", multi_line).option("enforceSchema", False).schema(schema).csv(path)
    rows = blank_missing(df.select(*(columns or names)), na_words)
    return rows.withColumn("row_ord", F.monotonically_increasing_id()) if row_ord else rows


def slim(df: DataFrame) -> DataFrame:
    """The columns that blocking needs, those that are there, with nulls as ''."""
    own = [c for c in SLIM_COLUMNS if c in df.columns]
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in own))


def first_rows(df: DataFrame, n: int, order: str = "entity_id") -> DataFrame:
    """The first n rows in the order of a column."""
    return df.orderBy(order).limit(n)


def lookup(pool: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows of the pool whose id is asked for."""
    return pool.join(ids.select(key).distinct(), key, "left_semi")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of the first column, without header and blank lines."""
    lines = spark.read.text(path)
    header = F.lower(F.trim(F.split("value", "\t")[0])) == "entity_id"
    ids = lines.filter(~header).select(F.trim(F.split("value", "\t")[0]).alias("entity_id"))
    return ids.filter("entity_id <> ''").distinct()


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_match_targets(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """All ids of several files; None and warnings if one is missing."""
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        return None, [f"id check off: {p} is missing" for p in missing]
    found = read_ids(spark, paths[0])
    for p in paths[1:]:
        found = found.union(read_ids(spark, p))
    return found.distinct(), []


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an id-list file with their number: line, value, id and ids (text after the first tab, null without one)."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    return split_id_list(lines)


def split_id_list(lines: DataFrame) -> DataFrame:
    tab = F.instr("value", "\t")
    first = F.when(tab > 0, F.substring(F.col("value"), F.lit(1), tab - 1)).otherwise(F.col("value"))
    rest = F.when(tab > 0, F.substring(F.col("value"), tab + 1, F.length("value")))
    return lines.select("*", F.trim(first).alias("id"), F.trim(rest).alias("ids"))


def parse_matches(c) -> F.Column:
    """A comma-separated list as an array of trimmed, non-blank ids; null and 'nan' are empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    ids = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.lower(F.trim(text)) == "nan", F.array().cast("array<string>")).otherwise(ids)


def write_table(df: DataFrame, path: str) -> None:
    """A tab-separated table with a header; '' stays empty."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_lists(lists: DataFrame, path: str, header: tuple[str, str]) -> None:
    """Lines of id, tab and comma-joined list, unquoted, under a header line, in the order of row_ord, or of the first
    column where there is none."""
    key, ids = lists.columns[:2]
    by = F.lpad(F.col("row_ord").cast("string"), 19, "0") if "row_ord" in lists.columns else F.col(key)
    lines = lists.select(F.lit(1).alias("o"), by.alias("k"), F.concat_ws("\t", F.col(key), F.array_join(F.array_distinct(ids), ",")).alias("value"))
    head = lists.sparkSession.createDataFrame([(0, None, "\t".join(header))], "o int, k string, value string")
    head.unionByName(lines.withColumn("k", F.col("k").cast("string"))).orderBy("o", "k").select("value").write.mode("overwrite").text(path)


def output_path(root: str, sample: int | None) -> str:
    """Sampled runs go to the logs, whole runs to the output."""
    return f"{root}/logs/candidate_pairs_sample.tsv" if sample else f"{root}/output/candidate_pairs.tsv"


def append_experiment(spark: SparkSession, path: str, **values) -> None:
    """Add one row to the experiment log; files of one folder, each with the header."""
    row = [None if values.get(c) is None else str(values[c]) for c in EXPERIMENT_COLUMNS]
    schema = StructType([StructField(c, StringType()) for c in EXPERIMENT_COLUMNS])
    spark.createDataFrame([row], schema).write.mode("append").option("header", True).csv(path)


def missed_pairs_json(missed: DataFrame, n: int = 100) -> str:
    """A JSON array of the first n missed pairs."""
    rows = missed.select("s1_id", "true_id").orderBy("s1_id", "true_id").limit(n).collect()
    return json.dumps([r.asDict() for r in rows])


def report(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)
