"""Readers, sinks and the checks of id-list files."""

import json

import pytest
from pyspark.sql import functions as F

from kinfold.operators import validation as V
from kinfold.sources import tables as T


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_reader_cases(spark, tmp_path):
    path = write(tmp_path / "a.tsv", 'entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Acme ""X"" Co"\t"a\nb"\tIN\nS1-2\tnull\tNA\t\nS1-3\t None\t007\tn/a\nS1-4\t"tab\there"\tx\ty\n')
    rows = [tuple(r) for r in T.read_source(spark, path).orderBy("entity_id").collect()]
    assert rows == [("S1-1", 'Acme "X" Co', "a\nb", "IN"), ("S1-2", "", "", ""), ("S1-3", " None", "007", ""), ("S1-4", "tab\there", "x", "y")]
    assert T.read_source(spark, path, columns=["country", "entity_id"]).columns == ["country", "entity_id"]
    assert T.read_source(spark, path, na_words=[]).filter("business_name = 'null'").count() == 1
    assert [r.entity_id for r in T.first_rows(T.read_source(spark, path), 2).collect()] == ["S1-1", "S1-2"]
    with pytest.raises(Exception):
        T.read_source(spark, path, columns=["absent"]).collect()


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", "", 'say "hi"', "x\ty")], "entity_id string, business_name string, business_address string, country string")
    T.write_table(df, str(tmp_path / "t"))
    assert [tuple(r) for r in T.read_source(spark, str(tmp_path / "t")).collect()] == [("S1-1", "", 'say "hi"', "x\ty")]


def test_lists(spark, tmp_path):
    lists = spark.createDataFrame([("S1-2", []), ("S1-1", ["S3-1", "S2-1", "S3-1"])], "source1_entity_id string, ids array<string>")
    T.write_lists(lists, str(tmp_path / "l"), ("source1_entity_id", "candidate_entity_ids"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "l")).collect()]
    assert lines == ["source1_entity_id\tcandidate_entity_ids", "S1-1\tS3-1,S2-1", "S1-2\t"]
    parsed = spark.createDataFrame([(" a, ,b",), (None,), ("nan",), ("",)], "c string").select(T.parse_matches(F.col("c")).alias("p"))
    assert [r.p for r in parsed.collect()] == [["a", "b"], [], [], []]


def test_ids_and_targets(spark, tmp_path):
    path = write(tmp_path / "s.tsv", "entity_id\tx\nS2-1\ta\n\n S2-2 \tb\nS2-1\tc\n")
    assert sorted(r.entity_id for r in T.read_ids(spark, path).collect()) == ["S2-1", "S2-2"]
    assert T.read_match_targets(spark, [path, str(tmp_path / "none")])[0] is None
    found, warnings = T.read_match_targets(spark, [path, path])
    assert found.count() == 2 and not warnings
    pool = spark.createDataFrame([("S2-1", 1), ("S2-9", 2)], "entity_id string, x int")
    assert [r.x for r in T.lookup(pool, found).collect()] == [1]


def test_sinks(spark, tmp_path):
    for n in (1, 2):
        T.append_experiment(spark, str(tmp_path / "log"), experiment_id=n, candidate_recall=0.95)
    log = spark.read.option("header", True).csv(str(tmp_path / "log"))
    assert log.columns == T.EXPERIMENT_COLUMNS and log.count() == 2
    missed = spark.createDataFrame([("S1-2", "a"), ("S1-1", "b")], "s1_id string, true_id string")
    assert json.loads(T.missed_pairs_json(missed, 1)) == [{"s1_id": "S1-1", "true_id": "b"}]
    assert T.output_path("r", 5) != T.output_path("r", None)
    T.report(missed)


def lines_of(spark, *lines):
    return T.split_id_list(spark.createDataFrame(list(enumerate(lines)), "line long, value string"))


def found(df):
    return {(r.check, r.line_id, r.detail) for r in df.collect()}


def test_row_checks(spark):
    lines = lines_of(spark, "S1-1\tS2-1,S3-2", "S1-1\tS2-1", "", "S1-2 S2-1", "S1-3\tS2-1,S2-1", "S1-4\tS1-1", "S1-5\tS2-1, S3-2", "S1-6\tS2-1,", "S1-7\t", "S1-8\tS2-1\textra")
    required = spark.createDataFrame([(f"S1-{i}",) for i in (1, 3, 4, 5, 6, 7, 9)], "entity_id string")
    valid = spark.createDataFrame([("S2-1",)], "entity_id string")
    assert found(V.check_lists(lines, required, valid)) == {
        ("no_tab", "S1-2 S2-1", "S1-2 S2-1"), ("duplicate_row", "S1-1", "2"), ("repeated_id", "S1-3", "1"), ("own_source_id", "S1-4", "S1-1"),
        ("bad_prefix", "S1-5", " S3-2"), ("bad_prefix", "S1-6", ""), ("unknown_id", "S1-1", "S3-2"), ("unknown_id", "S1-8", "S2-1\textra"),
        ("missing_row", "S1-9", "S1-9"), ("extra_row", "S1-8", "S1-8"),
    }
    assert tuple(V.list_counts(V.id_rows(lines)).first()) == (8, 1, 7)
    summary = {r.check: (r.total, r.sample) for r in V.summarise(V.check_lists(lines, required, valid)).collect()}
    assert summary["bad_prefix"] == (2, "S1-5,S1-6")


def test_subset_is_a_warning_and_the_last_line_counts(spark):
    matching = V.id_rows(lines_of(spark, "S1-1\tS2-9", "S1-1\tS2-1,S2-2", "S1-2\tS2-5", "S1-3\t"))
    candidates = V.id_rows(lines_of(spark, "S1-1\tS2-1", "S1-3\tS2-1"))
    out = V.outside_candidates(matching, candidates)
    assert found(out) == {("outside_candidates", "S1-1", "S2-2"), ("outside_candidates", "S1-2", "S2-5")}
    assert {r.severity for r in out.collect()} == {"warning"}


def test_headers():
    assert V.check_header(None, V.MATCH_HEADER) and V.check_header("", V.MATCH_HEADER)
    assert "comma" in V.check_header("source1_entity_id,matched_entity_ids", V.MATCH_HEADER)
    assert V.check_header("x\ty", V.MATCH_HEADER) and V.check_header(" Source1_Entity_ID\tmatched_entity_ids ", V.MATCH_HEADER) is None


def test_submission(spark, tmp_path):
    write(tmp_path / "test_source1.tsv", "entity_id\tn\nS1-1\ta\nS1-2\tb\n")
    for n in (2, 3):
        write(tmp_path / f"test_source{n}.tsv", f"entity_id\tn\nS{n}-1\ta\n")
    match = write(tmp_path / "m.tsv", "source1_entity_id\tmatched_entity_ids\r\nS1-1\tS2-1\r\nS1-2\t\r\n")
    cand = write(tmp_path / "c.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\tS3-1\n")
    errors, warnings, rows = V.validate_submission(spark, match, cand, str(tmp_path), check_ids=True)
    assert (errors, warnings, found(rows)) == ([], [], set())
    errors, warnings, rows = V.validate_submission(spark, match, str(tmp_path / "none"), str(tmp_path))
    assert not errors and len(warnings) == 2 and not found(rows)
    assert V.validate_submission(spark, match, cand, str(tmp_path / "no"))[0]
    assert V.validate_submission(spark, cand, None, str(tmp_path))[0]
    (tmp_path / "bad.tsv").write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\t\xff\n")
    assert "UTF-8" in V.validate_submission(spark, str(tmp_path / "bad.tsv"), cand, str(tmp_path))[0][0]
    assert V.validate_submission(spark, write(tmp_path / "e.tsv", ""), cand, str(tmp_path))[0]
