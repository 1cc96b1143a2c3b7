"""Blocking, ranking, fallback, evaluation, profiling and the stream extension."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinfold.functions.normalize import normalize_records
from kinfold.operators import blocking, evaluation, fallback, profiling, tally
from kinfold.plans import queries as Q
from kinfold.plans.candidates import BlockingConfig, generate_candidates
from kinfold.sources.tables import slim
from kinfold.streaming.incremental import block_stream


def records(spark, rows):
    raw = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    return normalize_records(raw)


def pool_of(spark, n, prefix="S2"):
    return records(spark, [(f"{prefix}-{i:03}", "alpha beta", "1 main road", "X") for i in range(n)])


KEY = blocking.KeySpec("token", lambda: F.col("sorted_token_key"), 2, 3)


@pytest.mark.parametrize("n", [2, 3, 10])
def test_bounds(spark, n):
    pool = slim(pool_of(spark, n))
    first = blocking.postings(pool, (KEY,), 100, "ordinal").first().ids
    assert sorted(first) == ["S2-000", "S2-001"]
    hashed = blocking.postings(pool, (KEY,), 100).first().ids
    assert len(hashed) == 2 and set(hashed) <= {f"S2-{i:03}" for i in range(n)}
    free = blocking.KeySpec("token", lambda: F.col("sorted_token_key"))
    assert [len(blocking.postings(pool, (k,), 1).first().ids) for k in (KEY, free)] == [2, 1]


def test_ordinal_puts_second_source_first(spark):
    pool = slim(pool_of(spark, 2, "S3")).unionByName(slim(pool_of(spark, 2, "S2")))
    assert set(blocking.postings(pool, (KEY,), 100, "ordinal").first().ids) == {"S2-000", "S2-001"}


def test_votes_count_families_and_shared_tokens(spark):
    s1 = records(spark, [("S1-1", "Alpha Beta", "12 Long Lane Harbour", "X"), ("S1-2", "", "", "")])
    pool = records(spark, [("S2-1", "Alpha Beta", "12 Long Lane Harbour", "X"), ("S3-1", "Other", "Harbour Long", "Y"), ("S2-1", "Alpha Beta", "12 Long Lane Harbour", "X")])
    votes = {(r.s1_id, r.cand_id): r.votes for r in blocking.count_votes(blocking.block(slim(s1), slim(pool))).collect()}
    # Eight families and two shared address tokens (long, harbour); a pool id that stands twice votes twice.
    assert votes == {("S1-1", "S2-1"): 2 * (8 + 2), ("S1-1", "S3-1"): 2}
    ranked = blocking.rank_votes(blocking.count_votes(blocking.block(slim(s1), slim(pool))), 1)
    assert [(r.cand_id, r.rnk) for r in ranked.collect()] == [("S2-1", 1)]
    lists = {r.source1_entity_id: r.candidate_entity_ids for r in blocking.candidate_lists(s1, ranked).collect()}
    assert lists == {"S1-1": ["S2-1"], "S1-2": []}
    assert {r.s1_id: r.n_candidates for r in blocking.weak_coverage(s1, ranked, 1).collect()} == {"S1-2": 0}


def test_bounds_reach_the_plan_before_the_shuffle(spark):
    plan = blocking.postings(slim(pool_of(spark, 3)), blocking.DEFAULT_KEYS, 10_000)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_cap_is_monotone_and_no_own_source(spark, sf_dir):
    s1, pool = Q.sides(spark, sf_dir)
    votes = blocking.count_votes(blocking.block(s1, pool)).cache()
    small, large = ({(r.s1_id, r.cand_id) for r in blocking.rank_votes(votes, n).collect()} for n in (3, 9))
    assert small < large and not any(c.startswith("S1-") for _, c in large)
    votes.unpersist()


def test_unseen_country_changes_no_country_free_family(spark, sf_dir):
    s1, pool = Q.sides(spark, sf_dir)
    free = tuple(k for k in blocking.DEFAULT_KEYS if k.id in ("phon_pref3", "sorted_token", "addr_tokens"))
    out = [{tuple(r) for r in blocking.count_votes(blocking.block(a, b, free)).collect()} for a, b in ((s1, pool), (s1.withColumn("country", F.lit("France")), pool.withColumn("country", F.lit("Narnia"))))]
    assert out[0] == out[1] and out[0]


def brute_tfidf(ours, theirs):
    def grams(text):
        return Counter(f" {w} "[i : i + n] for w in text.split() for n in (1, 2, 3) for i in range(len(w) + 3 - n))

    docs = {i: grams(t) for i, t in theirs.items()}
    df = Counter(g for d in docs.values() for g in d)
    idf = {g: math.log((1 + len(docs)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(d):
        w = {g: n * idf[g] for g, n in d.items() if g in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / size for g, x in w.items()} if size else {}

    vectors = {i: unit(d) for i, d in docs.items()}
    for s, text in ours.items():
        q = unit(grams(text))
        for i, v in vectors.items():
            if sim := sum(x * v[g] for g, x in q.items() if g in v):
                yield s, i, sim


def test_tfidf_weights(spark):
    theirs = {"S2-1": "acme tools main", "S2-2": "acme toys", "S3-1": "zebra quay", "S3-2": "acme tools", "S2-3": "q"}
    ours = {"S1-1": "acme tool", "S1-2": "zebras", "S1-3": ""}
    make = lambda d: records(spark, [(i, t, "", "X") for i, t in d.items()])
    got = {(r.s1_id, r.cand_id): r.similarity for r in fallback.tfidf_neighbours(slim(make(ours)), slim(make(theirs)), 10).collect()}
    want = {(s, i): x for s, i, x in brute_tfidf(ours, theirs)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    top = fallback.tfidf_neighbours(slim(make(ours)), slim(make(theirs)), 1).filter("s1_id = 'S1-1'").first()
    assert top.cand_id == "S3-2"
    other = slim(make(ours)).withColumn("country", F.lit("Y"))
    assert fallback.tfidf_neighbours(other, slim(make(theirs))).count() == 0
    split = fallback.tfidf_neighbours(slim(make(ours)), slim(make(theirs)), 10, pool_limit=2).collect()
    assert {(r.s1_id, r.cand_id) for r in split} == {("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-1", "S3-2"), ("S1-2", "S3-1")}


def test_fallback_merge_and_whole_pipeline(spark):
    ranked = spark.createDataFrame([("S1-1", "S2-9", 3, 1), ("S1-1", "S2-1", 1, 2)], "s1_id string, cand_id string, votes long, rnk int")
    extra = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-9"), ("S1-1", "S2-5"), ("S1-2", "S2-1")], "s1_id string, cand_id string")
    out = [(r.s1_id, r.cand_id, r.stage, r.rnk) for r in fallback.merge_fallback(ranked, extra, 3).orderBy("s1_id", "rnk").collect()]
    assert out == [("S1-1", "S2-9", 0, 1), ("S1-1", "S2-1", 0, 2), ("S1-1", "S2-5", 1, 3), ("S1-2", "S2-1", 1, 1)]
    s1 = records(spark, [("S1-1", "Acme Tools", "1 Main Road", "X")])
    s2, s3 = records(spark, [("S2-1", "Acme Tools", "1 Main Road", "X")]), records(spark, [("S3-1", "Acne Tolls", "", "X")])
    assert {(r.cand_id, r.stage) for r in generate_candidates(s1, s2, s3).collect()} == {("S2-1", 0), ("S3-1", 0)}
    none = generate_candidates(s1, s2, s3, BlockingConfig(run_fuzzy_fallback=False, keys=blocking.DEFAULT_KEYS[1:2]))
    assert [(r.cand_id, r.stage) for r in none.collect()] == [("S2-1", 0)]
    some = generate_candidates(s1, s2, s3, BlockingConfig(keys=blocking.DEFAULT_KEYS[1:2]))
    assert {(r.cand_id, r.stage) for r in some.collect()} == {("S2-1", 0), ("S3-1", 1)}


def test_evaluation(spark):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    pool = spark.createDataFrame([("S2-1",), ("S2-2",)], "entity_id string")
    truth = spark.createDataFrame([("S1-1", "S2-1, S3-1,,S2-1"), ("S1-2", None), ("S1-9", "S2-1"), ("S1-3", "nan")], "source1_entity_id string, matched_entity_ids string")
    cands = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-1")], "s1_id string, cand_id string")
    out, missed = evaluation.evaluate_blocking(cands, truth, s1, pool)
    r = out.first().asDict()
    assert (r["true_pairs"], r["captured"], r["missed"], r["candidate_recall"]) == (2, 1, 1, 0.5)
    assert (r["n_evaluated"], r["total_candidates"], r["avg_candidates"], r["max_candidates"], r["zero_candidates"]) == (3, 3, 1.0, 2, 1)
    assert r["reduction_ratio"] == 0.5 and [tuple(x) for x in missed.collect()] == [("S1-1", "S3-1")]
    empty, _ = evaluation.evaluate_blocking(cands.limit(0), truth.limit(0), s1.limit(0), pool)
    assert empty.first().candidate_recall == 0.0 and empty.first().reduction_ratio == 0.0


def test_macro_f05(spark):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",), ("S1-4",)], "entity_id string")
    truth = spark.createDataFrame([("S1-1", "a,c"), ("S1-2", ""), ("S1-3", ""), ("S1-4", "z")], "source1_entity_id string, matched_entity_ids string")
    pred = spark.createDataFrame([("S1-1", "a"), ("S1-1", "b"), ("S1-1", "c"), ("S1-3", "a"), ("S1-4", "y")], "s1_id string, cand_id string")
    each = {r.s1_id: round(r.f05, 3) for r in evaluation.f05_by_record(pred, truth, s1).collect()}
    assert each == {"S1-1": 0.714, "S1-2": 1.0, "S1-3": 0.0, "S1-4": 0.0}
    assert round(evaluation.f05_macro(pred, truth, s1).first().macro_f05, 4) == round(sum([5 / 7, 1, 0, 0]) / 4, 4)


def test_profiling(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), (None, "y")], "k string, v string")
    assert {r.column: r.missing_pct for r in profiling.missing_percent(df).collect()} == {"k": 25.0, "v": 50.0}
    assert {r.column: (r.missing_pct, r.n_distinct) for r in profiling.profile(df).collect()} == {"k": (25.0, 2), "v": (50.0, 2)}
    assert [tuple(r) for r in profiling.value_counts(df, "k").collect()] == [("a", 2), (None, 1), ("b", 1)]
    assert tuple(profiling.duplicate_rows(df).first()) == (4, 3, 1)
    assert tuple(profiling.shape(df).first()) == (4, 2, "k,v")
    truth = spark.createDataFrame([("1", "a,,b"), ("2", ""), ("3", None), ("4", "c")], "source1_entity_id string, matched_entity_ids string")
    assert [tuple(r) for r in profiling.match_count_histogram(truth).collect()] == [(0, 2), (1, 1), (3, 1)]
    assert profiling.singleton_percent(truth).first().singleton_pct == 50.0
    ids = spark.range(100).select(F.col("id").cast("string").alias("entity_id"))
    one, two = (sorted(r.entity_id for r in profiling.seeded_sample(ids.repartition(n), 10, 7).collect()) for n in (1, 5))
    assert one == two and len(one) == 10 and profiling.seeded_sample(ids, 1000, 7).count() == 100
    assert profiling.sample_values(df, "v").count() == 2


def test_stream_matches_batch(spark, tmp_path):
    raw = spark.createDataFrame([("S1-1", "Acme Tools", "1 Main Road", "X"), ("S1-2", "Zebra Quay", "9 Lane", "Y")], "entity_id string, business_name string, business_address string, country string")
    raw.write.parquet(str(tmp_path / "in"))
    pool = records(spark, [("S2-1", "Acme Tools", "2 Main Road", "X"), ("S3-1", "Zebra Key", "9 Lane", "Y")])
    block_stream(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in")), pool, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {(r.s1_id, r.cand_id, r.votes) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in blocking.count_votes(blocking.block(slim(normalize_records(raw)), slim(pool))).collect()}
    assert got == want and got


def test_full_queries_keep_every_candidate(spark):
    """At sf0.01 records have more than 100 candidates; the full queries lose none and take 300 neighbours."""
    sf = "/root/testdata/sf0.01"
    every = {(r.s1_id, r.cand_id): r.votes for r in Q.votes(spark, sf).collect()}
    most = max(Counter(s for s, _ in every).values())
    assert most > 100
    assert {(r.s1_id, r.cand_id): r.votes for r in Q.queries()["ranked_full"](spark, sf).collect()} == every
    assert Q.queries()["coverage_report_full"](spark, sf).first().most == most
    out = Q.queries()["candidates_full"](spark, sf).collect()
    assert {(r.s1_id, r.cand_id) for r in out if r.stage == 0} == every.keys()
    assert max(Counter(r.s1_id for r in out if r.stage == 1).values()) > 15


def test_neighbours_of_a_large_country_are_not_cut_by_first_character(spark, tmp_path):
    """More than 20,000 pool records of a country, the nearest of which have other first characters."""
    rows = [(0, "quorn bazaar", "en"), (1, "bazaar quorn", "en"), (2, "quarn bazar", "en"), (3, "xquorn bazaar", "en")]
    rows += [(i, f"q{i} ab", "en") for i in range(6, 26_000) if i % 5]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    near = Q.queries()["tfidf_topk"](spark, str(tmp_path)).orderBy(F.desc("similarity"), "cand_id").collect()
    assert [r.cand_id for r in near[:3]] == ["S2-00000001", "S3-00000003", "S2-00000002"] and len(near) == 15


def test_tally_equals_block_count_and_rank(spark, sf_dir, monkeypatch):
    """Counting by units in blocks gives the votes, ranks and counts of a row for each vote, whatever the sizes."""
    s1, pool = Q.sides(spark, sf_dir)
    s1 = s1.unionByName(s1.filter("entity_id < 'S1-00000050'"))  # ids that stand twice vote twice
    copies = s1.withColumn("entity_id", F.concat("entity_id", F.lit("-copy")))  # equal keys: one unit
    s1, pool = s1.unionByName(copies), pool.unionByName(pool.limit(20))
    votes = blocking.count_votes(blocking.block(s1, pool, cap=10_000))
    monkeypatch.setattr(tally, "BLOCK_VOTES", 400)
    monkeypatch.setattr(tally, "UNIT_RECORDS", 1)
    staged = tally.stage(s1, pool, cap=10_000)
    assert staged.n_blocks > 3
    for keep in (None, 7):
        want = {tuple(r) for r in blocking.rank_votes(votes, keep or 10**9).select("s1_id", "cand_id", "votes", "rnk").collect()}
        assert {tuple(r) for r in tally.ranked(staged, keep).collect()} == want
        assert {tuple(r) for r in tally.candidate_counts(staged, keep).collect()} == set(Counter(r[0] for r in want).items())
    assert {r.s1_id for r in tally.covered(staged).collect()} == {r[0] for r in want}
    nothing = tally.stage(s1.limit(0), pool)
    assert tally.ranked(nothing).count() == 0 and tally.candidate_counts(nothing).count() == 0


def test_counting_reads_no_row_for_each_vote(spark, sf_dir):
    """The plans of counts and lists shuffle posting lists, never pairs."""
    pair = Q.sides(spark, sf_dir)
    for df in (Q.coverage(spark, sf_dir), Q.weak(spark, sf_dir, pair=pair), Q.candidate_lists(spark, sf_dir), Q.ranked(spark, sf_dir), Q.reduction_ratio(spark, sf_dir)):
        plan = df._jdf.queryExecution().toString()
        assert "FlatMapGroupsInArrow" in plan and "cand_id" not in plan.split("FlatMapGroupsInArrow")[-1] and "Window" not in plan


def test_counts_settled_by_a_single_list(spark, sf_dir, monkeypatch):
    """A unit with enough distinct ids in one list is not counted; repeats of an id in a list are no further candidates."""
    s1 = slim(records(spark, [("S1-1", "Alpha Beta", "", "X"), ("S1-2", "Gamma", "", "X"), ("S1-3", "Delta Omega", "", "X")]))
    pool = slim(records(spark, [(f"S2-{i}", "Alpha Beta", "", "X") for i in (1, 2, 3)] + [("S2-7", "Gamma", "", "X")] * 3))
    staged = tally.stage(s1, pool)
    counted, by_unit = [], tally._by_unit
    monkeypatch.setattr(tally, "_by_unit", lambda staged, *rest: counted.extend(staged.units.collect()) or by_unit(staged, *rest))
    assert {tuple(r) for r in tally.candidate_counts(staged, 3).collect()} == {("S1-1", 3), ("S1-2", 1)}
    assert [r.members for r in counted] == [["S1-2"]]
    assert {tuple(r) for r in tally.candidate_counts(staged, 4).collect()} == {("S1-1", 3), ("S1-2", 1)}


def test_weak_coverage_counts_no_further_than_its_threshold(spark, sf_dir, monkeypatch):
    kept, count = [], tally.candidate_counts
    monkeypatch.setattr(tally, "candidate_counts", lambda staged, keep=None: kept.append(keep) or count(staged, keep))
    small = {tuple(r) for r in Q.queries()["weak_coverage_full"](spark, sf_dir).collect()}
    assert kept == [100] and small and all(n < 100 for _, n in small)


def test_blocks_follow_votes_and_not_partitions(spark, monkeypatch):
    """Each block gets lists of its own, so more partitions must not mean more copies of the lists."""
    weights = spark.range(1000).selectExpr("id as unit", "1000000L as votes", "1 as largest")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    blocks = []
    for n in ("200", "3000"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        blocks.append(tally._blocks(weights))
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert blocks == [32, 32]


def test_pairs_leave_a_block_as_rows(spark, sf_dir, monkeypatch):
    """Pairs come from the block in bounded batches; no array of candidates is exploded for each record."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(tally, "PAIR_ROWS", 2)
    args = pa.array([["a", "b"], ["c"]]), np.array([2, 1]), np.array([1, 0, 2]), np.array([5, 4, 3]), pa.array(["x", "y", "z"])
    batches = list(tally._pairs(*args))
    rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert rows == [("a", "y", 5, 1), ("a", "x", 4, 2), ("b", "y", 5, 1), ("b", "x", 4, 2), ("c", "z", 3, 1)]
    assert max(map(len, batches)) <= 3 and len(batches) > 1
    assert "posexplode" not in Q.ranked(spark, sf_dir)._jdf.queryExecution().toString()


@pytest.mark.parametrize("form", ["lists", "pairs", "counts"])
def test_steps_of_a_block_hold_few_votes(form):
    """A block of a million votes in batches of three lists: no batch is much larger than a step, and no step takes 32 MB."""
    import tracemalloc

    import pyarrow as pa

    n, size, per = 9, 4_000, 30
    kind = pa.schema([("own", pa.bool_()), ("units", pa.list_(pa.int64())), ("ids", pa.list_(pa.string()))])
    rows = [(False, list(range(k, k + per)), [f"S2-{i * 7 % 9_973:08}" for i in range(k * 900, k * 900 + size)]) for k in range(n)]
    rows += [(True, [u], [f"S1-{u:08}"]) for u in reversed(range(n + per))]
    batches = [pa.record_batch([list(c) for c in zip(*rows[i : i + 3])], schema=kind) for i in range(0, len(rows), 3)]
    tracemalloc.start()
    out = list(tally._unit_rows(iter(batches), None, form))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {}
    for _, units, ids in rows[:n]:
        for u in units:
            want.setdefault(f"S1-{u:08}", Counter()).update(ids)
    want = {m: sorted(c.items(), key=lambda x: (-x[1], x[0])) for m, c in want.items()}
    found = [r for b in out for r in b.to_pylist()]
    if form == "lists":
        assert {m: list(zip(r["cands"], r["votes"])) for r in found for m in r["members"]} == want
        assert max(len(b["cands"].flatten()) for b in out) <= tally.STEP_VOTES + n * size
    elif form == "pairs":
        assert sorted(tuple(r.values()) for r in found) == sorted((m, c, v, k) for m, x in want.items() for k, (c, v) in enumerate(x, 1))
    else:
        assert {m: r["n"] for r in found for m in r["members"]} == {m: len(x) for m, x in want.items()}
    assert peak < 32 << 20
