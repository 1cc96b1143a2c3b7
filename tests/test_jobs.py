"""The commands from file to file, the recall gate and exit codes."""

import json
from pathlib import Path

from kinfold.jobs import main
from kinfold.operators import evaluation
from kinfold.sources import tables as T

HEADER = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def sources(tmp_path):
    names = ["Acme Trading Company", "Blue Lake Foods", "Zeta Motors Limited", "Quiet Books"]
    for n in (1, 2, 3):
        order = names[::-1] if n == 1 else names
        rows = [f"S{n}-{names.index(x)}\t{x}\t{10 + names.index(x)} Main Road\tIN" for x in order]
        (tmp_path / f"s{n}.tsv").write_text(HEADER + "\n".join(rows) + "\n")
    return [str(tmp_path / f"s{n}.tsv") for n in (1, 2, 3)]


def lines_of(path):
    return [x for f in sorted(Path(path).glob("part-*")) for x in f.read_text().splitlines()]


def test_block_writes_in_input_order_and_gates_on_recall(spark, tmp_path):
    paths = sources(tmp_path)
    truth = tmp_path / "truth.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{k}\tS2-{k},S3-{k}\n" for k in range(4)))
    assert main(["block", *paths, str(tmp_path), "--truth", str(truth)], spark) == 0
    lines = lines_of(tmp_path / "output/candidate_pairs.tsv")
    assert [x.split("\t")[0] for x in lines] == ["source1_entity_id", "S1-3", "S1-2", "S1-1", "S1-0"]
    assert all({f"S2-{k}", f"S3-{k}"} <= set(x.split("\t")[1].split(",")) for k, x in zip((3, 2, 1, 0), lines[1:], strict=True))
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-0\tS2-77\nS1-1\tS2-1\n")
    assert main(["block", *paths, str(tmp_path), "--truth", str(truth), "--sample", "2", "--skip-fuzzy-fallback", "--pool-limit", "3"], spark) in (0, 1)
    assert len(lines_of(tmp_path / "logs/candidate_pairs_sample.tsv")) == 3
    log = spark.read.option("header", True).csv(str(tmp_path / "logs/experiments"))
    assert log.count() == 2 and log.columns == T.EXPERIMENT_COLUMNS


def test_recall_gate(spark, tmp_path):
    cands = spark.createDataFrame([("S1-1", "S2-1", 1)], "s1_id string, cand_id string, votes long")
    truth = spark.createDataFrame([("S1-1", "S2-1,S2-2")], "source1_entity_id string, matched_entity_ids string")
    cols = "entity_id string, normalized_name string, normalized_address string, country string"
    s1, pool = spark.createDataFrame([("S1-1", "a", "b", "IN")], cols), spark.createDataFrame([("S2-1", "a", "b", "IN"), ("S2-2", "c", "d", "IN")], cols)
    metrics, detail = evaluation.recall_gate(cands, truth, s1, pool, json_path=str(tmp_path / "missed"))
    assert not metrics["passed"] and metrics["candidate_recall"] == 0.5 and [r.true_normalized_name for r in detail.collect()] == ["c"]
    assert [json.loads(x)["true_id"] for f in (tmp_path / "missed").glob("*.json") for x in f.read_text().splitlines()] == ["S2-2"]
    assert evaluation.recall_gate(cands, truth, s1, pool, target=0.5)[1] is None


def test_normalize_and_validate(spark, tmp_path):
    for n, path in enumerate(sources(tmp_path), 1):
        (tmp_path / f"test_source{n}.tsv").write_text(Path(path).read_text())
    assert main(["normalize", str(tmp_path / "s1.tsv"), str(tmp_path / "n1")], spark) == 0
    row = T.read_source(spark, str(tmp_path / "n1")).filter("entity_id = 'S1-0'").first()
    assert row.normalized_name == "acme trading co" and row.normalized_address == "10 main rd"
    good, bad = tmp_path / "good.tsv", tmp_path / "bad.tsv"
    good.write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{k}\tS2-{k}\n" for k in range(4)))
    bad.write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{k}\tS2-{k}9\n" for k in range(3)))
    assert main(["validate", str(good), "--test-dir", str(tmp_path), "--check-ids"], spark) == 0
    assert main(["validate", str(bad), "--test-dir", str(tmp_path), "--check-ids"], spark) == 1
    assert main(["validate", str(tmp_path / "absent.tsv"), "--test-dir", str(tmp_path)], spark) == 1
