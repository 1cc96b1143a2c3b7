"""Operators with one right result, against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from kinfold.llm import decontaminate, hamming, minhash, packing, suffix_dedup, token_store
from kinfold.llm import queries as Q
from kinfold.llm.suffix_array import permuted_common_prefixes, suffix_array

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def texts(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def brute_contamination(rows, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[i : i + window])].add(item)
    sizes = {len(k) for k in windows}
    for doc, text in rows:
        w, hit, ids = words_of(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    ids |= own
        ids.discard(None)
        yield doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)


def test_op1(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(map(tuple, Q.op1_decontaminate(spark, sf_dir).collect()))
    assert got == sorted(brute_contamination(texts(spark, sf_dir), items))
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_decontamination_cases_and_offsets(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Ä! {item.upper().replace(' ', ' -- ')} end"), (2, None), (3, ""), (4, "tiny ITEM"), (4, "tiny ITEM"), (None, "a tiny item"), (5, "one two three")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "n_hit")
    items = [(7, item), (7, item), (8, "Tiny item"), (None, "one two three four five six seven eight nine ten"), (9, None), (10, "?!")]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int")
    for most in (1 << 20, 20):
        out = {(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)): r.spans for r in decontaminate.find_contamination(docs, bench, max_bytes=most).collect()}
        assert set(out) == {(1, 13, 11, ("7",)), (2, 0, 0, ()), (3, 0, 0, ()), (4, 2, 2, ("8",)), (None, 3, 2, ("8",)), (5, 3, 0, ())}
        (span,) = out[1, 13, 11, ("7",)]
        assert rows[0][1][span.start : span.end] == item.upper().replace(" ", " -- ")
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]


def brute_repeats(rows, length=100):
    first = {}
    rows = sorted((i, (t or "").encode()) for i, t in rows)
    for doc, text in rows:
        for i in range(len(text) - length + 1):
            first.setdefault(text[i : i + length], (doc, i))
    for doc, text in rows:
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - length + 1):
            if first[text[i : i + length]] != (doc, i):
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(text, np.uint8)[~gone[:-1]])
        yield doc, len(text), len(text) - len(kept), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_op5(spark, sf_dir):
    got = sorted(map(tuple, Q.op5_suffix_dedup(spark, sf_dir).collect()))
    assert got == sorted(brute_repeats(texts(spark, sf_dir)))
    assert sum(r[2] > 0 for r in got) > 5


def repeats(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffix_dedup.remove_repeats(docs, **options).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out if r.doc_id is not None)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_dedup_random(spark, seed):
    """Texts stitched from few phrases, runs of one letter, edits and copies; small shards."""
    rng = np.random.default_rng(seed)
    phrases = ["".join(rng.choice(list("abé\n "), int(rng.integers(1, 260)))) for _ in range(8)] + ["x" * 300, "ab" * 200, "é" * 90]
    rows = []
    for i in range(60):
        text = "".join(phrases[int(k)] + chr(97 + int(rng.integers(0, 26))) * int(rng.integers(0, 3)) for k in rng.integers(0, len(phrases), int(rng.integers(0, 6))))
        rows.append((int(i * 7 % 61), text))
    rows[5] = (rows[5][0], None)
    assert repeats(spark, rows, shard_bytes=3000) == sorted(brute_repeats(rows))
    assert repeats(spark, rows, length=40, gram=8, most_contexts=2) == sorted(brute_repeats(rows, 40))


def test_suffix_dedup_cases(spark):
    assert repeats(spark, [(1, None)]) == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]
    docs = spark.createDataFrame([(1, "a" * 150 + "Ä"), (1, "a" * 150 + "Ä"), (None, "a" * 150), (2, "b" + "Ä" + "a" * 100)], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect())
    assert out == [(0, 0, 0), (1, 149, 1), (1, 149, 1), (2, 100, 1)]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    wide = spark.createDataFrame([(i, "é" * 60 + str(i) + "tail", "en", f"s{i}", 99) for i in range(3)] + [(9, "é" * 60, "en", None, None)], DOCS).withColumnRenamed("lang", "kept")
    cut = {r.doc_id: r for r in suffix_dedup.cut_repeats(wide).collect()}
    assert set(cut) == {0, 1, 2} and cut[1].text == "1tail" and cut[1].n_chars == 5 and cut[0].text == "é0tail" and cut[2].source == "s2"


def test_hot_passage_is_refined(spark):
    """One passage in every document with its own words around it, by few contexts for each anchor, and a text beyond the buffer."""
    rng = np.random.default_rng(12)
    passage = "".join(rng.choice(list("abcdefgh "), 400))
    rows = [(i, "".join(rng.choice(list("xyzuvw"), 80 + i % 7)) + "\n " + passage[: 400 - i % 3] + "".join(rng.choice(list("rst "), 90))) for i in range(120)]
    rows.append((500, "".join(f"{k} bottles of beer on the wall, take {k % 7} down and pass them around. " for k in range(400))))
    rows.append((501, rows[-1][1][5000:9000]))
    assert repeats(spark, rows, most_contexts=8, buffer_bytes=3000, sample_rows=20) == sorted(brute_repeats(rows))


def test_suffix_dedup_ids(spark):
    """Different texts of one doc_id are documents of their own; ids that are no integers raise."""
    a, b = "p" * 40 + "first text " * 12, "second " * 30
    rows = [(1, a), (1, b), (1, b), (2, a), (2, b + "end")]
    out = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    alone = [next(brute_repeats([(1, t)]))[2] for t in (a, b)]
    assert out == sorted([(1, len(a), alone[0]), (1, len(b), alone[1]), (1, len(b), alone[1]), (2, len(a), len(a)), (2, len(b) + 3, len(b))])
    with pytest.raises(TypeError):
        suffix_dedup.remove_repeats(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for n in range(120):
        text = bytes(rng.integers(0, 1 + n % 4, n, np.uint8) + 253 * (n % 2))
        array = np.frombuffer(text, np.uint8)
        sa = suffix_array(array)
        assert sa.tolist() == sorted(range(n), key=lambda i: text[i:])
        prefixes = permuted_common_prefixes(array, sa, 12)
        for a, b in zip(sa, sa[1:], strict=False):
            shared = next((k for k in range(12) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or b + k >= n or a + k >= n), 12)
            assert prefixes[b] == shared


def brute_components(rows, width, percent, low=lambda b: b.lower()):
    sets = {}
    for doc, text in rows:
        w = low((text or "").encode()).split()
        sets[doc] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    owners = defaultdict(set)
    for doc, s in sets.items():
        for x in s:
            owners[x].add(doc)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for doc, s in sets.items():
        for other in {o for x in s for o in owners[x] if o < doc}:
            both = len(s & sets[other])
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                a, b = sorted((find(doc), find(other)))
                root[b] = a
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def test_op10(spark, sf_dir):
    got = sorted(map(tuple, Q.op10_minhash(spark, sf_dir).collect()))
    assert got == brute_components(texts(spark, sf_dir), 3, 85)
    assert not all(r[3] for r in got)


def test_minhash_chains_and_cases(spark):
    """A long chain of small edits, a star of copies, short texts and empty ones."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows, now = [], list(base)
    for i in range(40):
        now = list(now)
        now[int(rng.integers(0, 120))] = f"x{i}"
        rows.append((100 + i * 3 % 121, " ".join(now)))
    for i in range(40):
        star = list(base)
        for k in rng.integers(0, 120, 2):
            star[int(k)] = f"y{i}{k}"
        rows.append((300 + i, "\t".join(star).upper()))
    rows += [(1, "a b"), (2, "A  B"), (3, "b a"), (4, None), (5, ""), (6, " \n"), (7, "a"), (8, "a b c"), (9, "a b c")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(map(tuple, minhash.near_duplicates(docs, wave=2).collect()))
    assert got == brute_components(rows, 3, 85)
    repeated = docs.unionByName(docs.filter("doc_id < 10")).unionByName(spark.createDataFrame([(None, "a b", "y")], docs.schema))
    again = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(repeated).filter("doc_id is not null").collect())
    assert sorted(set(again)) == [(d, c, k) for d, _, c, k in got] and len(again) == len(got) + 9
    assert [tuple(r) for r in minhash.near_duplicates(repeated).filter("doc_id is null").collect()] == [(None, 1, None, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _, _, k in got if k}


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_minhash_group_around_the_threshold(spark, width, percent):
    """One group whose members mostly link neither with its hub nor with each other, but some by edits they share."""
    rng = np.random.default_rng(width)
    base, rows = [f"w{i}" for i in range(150)], [(900, " ".join(f"w{i}" for i in range(150)))]
    for i in range(120):
        words = list(base)
        for k in rng.integers(0, 150, int(rng.integers(2, 14))):
            words[int(k)] = f"e{k}v{int(rng.integers(0, 2))}"
        rows.append((int(i * 7 % 121), " ".join(words[: int(rng.integers(125, 151))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(docs, width, percent, wave=4).collect()))
    assert got == brute_components(rows, width, percent)
    assert 1 < len({r[2] for r in got}) < len(rows)


def test_minhash_texts_of_many_candidates(spark):
    """Beyond the bound of the broadcast the texts are joined by a shuffle, with the same rows."""
    docs = spark.createDataFrame([(i % 40, f"text {i % 40}") for i in range(80)], "doc_id long, text string")
    wanted = docs.filter("doc_id % 3 = 0").select("doc_id").distinct()
    small, large = (sorted((r.doc_id, bytes(r.packed)) for r in minhash.texts_of(docs, wanted, n).collect()) for n in (1 << 20, 0))
    assert small == large and [d for d, _ in small] == list(range(0, 40, 3))


def test_minhash_repeated_ids_and_names(spark):
    """A doc_id at different texts is linked by each of them; null texts too; odd column names stay."""
    rng = np.random.default_rng(21)
    a, b, c = ([f"{x}{int(k)}" for k in rng.integers(0, 10**6, 80)] for x in "abc")
    rows = [(1, a), (1, b), (3, [*b, "z"]), (5, c), (5, b), (7, [*c, "y"]), (8, ["only"]), (8, []), (9, ["only"]), (4, [*a, "x"])]
    docs = spark.createDataFrame([(i, " ".join(w) or None, n) for n, (i, w) in enumerate(rows)], "doc_id int, text string, `a.b` int")
    out = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert out == sorted((i, max(len(w) - 2, min(len(w), 1)), 8 if i > 7 else 1, i in (1, 8)) for i, w in rows)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 8}
    with pytest.raises(TypeError):
        minhash.near_duplicates(docs.withColumn("doc_id", docs.doc_id.cast("string")))
    long = " ".join(f"w{k}" for k in range(2000)).encode()
    assert (minhash.word_hashes(long, 100) == minhash.word_hashes(long)).all()


def test_op6_round_trip(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path(Q.TOKENIZER)))
    want, start = [], 0
    for doc, text in sorted(texts(spark, sf_dir)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, Q.op6_token_store(spark, sf_dir).collect())) == want


def test_tokenizer_pieces_equal_the_library():
    import public_tokenizers

    path = str(public_tokenizers.path(Q.TOKENIZER))
    odd = ["", " ", "It's THEY'LL ''s !!'s 'sound 'S's x're'", "<|endoftext|> x<|y", "naïve ŒUVRE ½ ²³ 12a3 ªº µ", "日本語 text ΟΔΟΣ", "é   a\x1cb \x85c", "İstanbul ß ẞ", "a­b", "a_b-c\t\r\n$%&*", "Ǆ ǅ ŉ", "×÷±«»¿ 3×4", "'", "'l", "'ll", "o'clock'd", "ƁƆ Ⱥ ǀx", "a\u00a0b", "¼'t"]
    rng = np.random.default_rng(17)
    odd += ["".join(rng.choice(list("abSTrvemld''  .,-19é×²µÀ\n"), int(rng.integers(1, 60)))) for _ in range(300)]
    tokenizer = token_store.WordTokenizer(path, most=5)
    want = [tokenizer.library.encode(t, add_special_tokens=False).ids for t in odd]
    for _ in range(2):
        assert [x.tolist() for x in tokenizer.encode([t.encode() for t in odd])] == want
    assert [x.tolist() for t in odd for x in tokenizer.encode([t.encode()])] == want
    other = token_store.WordTokenizer(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert not other.keeps and [x.tolist() for x in other.encode([b"It's", b""])] == [other.library.encode("It's").ids, []]


def test_huffman_codes():
    rng = np.random.default_rng(2)
    for size, limit in ((2, 4), (9, 4), (300, 9), (300, 16), (1, 5)):
        counts = np.zeros(size + 3, np.int64)
        counts[:size] = (rng.pareto(0.5, size) * 5 + 1).astype(np.int64).clip(max=10**9)
        lengths = token_store.code_lengths(counts, limit)
        used = lengths[counts > 0].astype(float)
        assert used.max() <= limit and (lengths[counts == 0] == 0).all() and (size == 1 or (2.0**-used).sum() == 1.0)
        codes = token_store.canonical_codes(lengths)
        table = token_store.decode_table(lengths, codes, limit)
        for n in (0, 1, 7, 8, 9, 500):
            ids = rng.integers(0, size, n).astype(np.uint16)
            stream, offsets = token_store.encode_block(ids, codes, lengths, 8)
            assert (token_store.decode_block(stream, offsets, n, table, limit, 8) == ids).all()
            assert len(offsets) == 4 * -(-n // 8)
    # Package-merge is optimal: no limited code of these counts is shorter than the unlimited optimum when that fits.
    assert token_store.code_lengths(np.array([1, 1, 2, 4, 8]), 4).tolist() == [4, 4, 3, 2, 1]
    assert (token_store.code_lengths(np.array([1, 1, 2, 4, 8]), 3) * np.array([1, 1, 2, 4, 8])).sum() == 3 * 8 + 8


def test_token_store_cases(spark, tmp_path):
    import public_tokenizers

    path = str(public_tokenizers.path(Q.TOKENIZER))
    rows = [(5, "b a", 1), (2, None, 2), (9, "", 3), (-3, "one two", 4), (None, "x", 5), (7, "y z", 6), (7, "w", 7), (7, "y z", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    out = sorted(map(tuple, token_store.read_token_store(spark, token_store.write_token_store(docs, f"file://{tmp_path}/a", path, 2), keep_ids=True).collect()), key=lambda r: r[1])
    assert [r[0] for r in out] == [None, -3, 2, 5, 7, 7, 7, 9] and [r[1] for r in out] == np.cumsum([0, *(r[2] for r in out[:-1])]).tolist() and out[2][4] == [2]
    again = token_store.read_token_store(spark, token_store.write_token_store(docs.repartition(3), f"file://{tmp_path}/c", path, 2), keep_ids=True).collect()
    assert sorted(map(tuple, again), key=lambda r: r[1]) == out
    assert token_store.read_token_store(spark, token_store.write_token_store(docs.limit(0), f"file://{tmp_path}/b", path, 2)).count() == 0
    with pytest.raises(TypeError):
        token_store.write_token_store(docs.withColumn("doc_id", docs.doc_id.cast("string")), f"file://{tmp_path}/d", path, 2)


def test_token_store_files(spark, sf_dir, tmp_path):
    """Files by name, and rows in them, are in ascending doc_id order, and another session reads the store from its path alone."""
    import subprocess
    import sys
    from pathlib import Path

    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    tokenizer = str(public_tokenizers.path(Q.TOKENIZER))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    docs = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 1000))
    token_store.write_token_store(docs, f"file://{tmp_path}/store", tokenizer, 2)
    files = sorted(Path(f"{tmp_path}/store/blocks").glob("part-*"))
    ids = [i for f in files for block in pq.read_table(f)["doc_ids"].to_pylist() for i in block]
    assert len([f for f in files if pq.read_metadata(f).num_rows]) > 3 and ids == sorted(r.doc_id for r in docs.collect())
    code = f"""
import json
from pyspark.sql import SparkSession
from kinfold.llm.token_store import read_token_store
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print(json.dumps(sorted(([r.start, r.doc_id, r.ids] for r in read_token_store(s, "file://{tmp_path}/store", True).collect()))))
"""
    root = Path(__file__).parents[2]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    import json

    library, want, start = Tokenizer.from_file(tokenizer), [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        want.append([start, r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [2]])
        start += len(want[-1][2])
    assert json.loads(out.strip().splitlines()[-1]) == want


def brute_nearest(rows, k, every):
    codes = {i: int("".join("1" if x is not None and x > 0 else "0" for x in e).ljust(64, "0"), 2) for i, e in rows if i is not None and e is not None}
    for q in sorted(codes):
        if q % every == 0:
            near = sorted((bin(codes[q] ^ c).count("1"), i) for i, c in codes.items() if i != q)[:k]
            yield from ((q, i, d, n + 1) for n, (d, i) in enumerate(near))


def test_op7(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, Q.op7_hamming_topk(spark, sf_dir).collect())) == sorted(brute_nearest(rows, 10, 100))


def test_hamming_hot_codes_and_cases(spark):
    rng = np.random.default_rng(6)
    hot = [float(x) for x in rng.normal(size=64)]
    rows = [(i, hot if i % 3 == 0 else [x * (1 if rng.random() < 0.93 else -1) for x in hot]) for i in range(900)]
    rows += [(901, None), (None, hot), (902, [None, float("nan"), 1.0]), (903, []), (0, hot)]
    vectors = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<float>, distance int")
    got = sorted(map(tuple, hamming.nearest_embeddings(vectors, k=7, every=50).collect()))
    assert got == sorted(brute_nearest(rows, 7, 50))
    codes = hamming.sign_codes(vectors)
    parts = sorted(map(tuple, hamming.nearest_codes(codes, codes.filter("vec_id % 50 = 0"), 7, block=4, shard_codes=50).collect()))
    assert parts == got
    assert hamming.nearest_embeddings(vectors.limit(0)).count() == 0
    few = hamming.nearest_embeddings(vectors.filter("vec_id in (0, 1, 100)"), k=7)
    assert {r.query_id for r in few.collect()} == {0, 100} and few.count() == 4


def test_multi_index_search_is_exact():
    rng = np.random.default_rng(8)
    for n, flips in ((1, 0.5), (50, 0.02), (3000, 0.02), (3000, 0.5)):
        bits = (rng.random((n, 64)) < flips).astype(np.uint8)
        codes = np.unique(np.packbits(bits, axis=1), axis=0)
        index = hamming.CodeIndex(codes)
        for q in codes[:20]:
            numbers, d = index.search(q, 5)
            want = np.sort(np.unpackbits(codes ^ q, axis=1).sum(1))[:5]
            assert (np.sort(d)[: len(want)] == want).all() and len(set(numbers.tolist())) == len(numbers)
            assert (d == np.unpackbits(codes[numbers] ^ q, axis=1).sum(1)).all()
            assert (np.unpackbits(codes ^ q, axis=1).sum(1) <= want[-1]).sum() == (d <= want[-1]).sum()


def brute_best_fit(items, capacity, most):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [
            (capacity - sum(x[0] for x in b), n)
            for n, b in enumerate(bins)
            if capacity - sum(x[0] for x in b) >= size
            and not (cluster is not None and any(x[2] == cluster for x in b))
            and not (source is not None and sum(x[1] == source for x in b) >= most)
        ]
        n = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        out.append((n, sum(x[0] for x in bins[n])))
        bins[n].append((size, source, cluster))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_best_fit(seed):
    rng = np.random.default_rng(seed)
    items = [(int(rng.integers(1, 40)), [None, "a", "b", "c"][int(rng.integers(0, 4))], [None, 1, 2, *range(3, 90)][int(rng.integers(0, 90) * rng.random() ** 2)]) for _ in range(400)]
    items.sort(key=lambda x: -x[0])
    for most in (1, 3):
        assert packing.best_fit(items, 40, most) == brute_best_fit(items, 40, most)


def test_op2(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = Q.op2_best_fit_packing(spark, sf_dir).collect()
    size = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    total, bins = defaultdict(int), defaultdict(list)
    for r in out:
        total[r.doc_id] += r.n_tokens
        if r.bin_id is not None:
            bins[r.bin_id].append((r.start, r.n_tokens))
    assert dict(total) == size
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and sum(b[-1]) <= 2048
    assert sum(size.values()) > 0.6 * 2048 * len(bins)


@pytest.mark.parametrize("apart", (False, True))
def test_packing_equals_brute_force(spark, apart):
    """Every shard as one-by-one search over all its bins packs it: conflicts of sources and clusters, tightness, order."""
    rng = np.random.default_rng(30)
    base = [f"w{int(k)}" for k in rng.integers(0, 10**6, 60)]
    rows = [(i, " ".join(f"v{i}x{k}" for k in range(int(rng.integers(0, 90)))), ["hot", "hot", None, "b"][int(rng.integers(0, 4))]) for i in range(300)]
    rows += [(300 + i, " ".join([*base, f"tail{i}"]), "c") for i in range(20)] + [(400 + i, " ".join(base), f"s{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = (packing.pack_apart if apart else packing.pack_documents)(docs, capacity=64, max_per_source=2, shard_rows=100).collect()
    text, source = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}
    cluster = {i: "near" if apart and i >= 300 else t or None for i, t in text.items()}
    shards = defaultdict(list)
    for r in out:
        if r.bin_id is not None:
            shards[r.bin_id >> 32].append(r)
    assert len(shards) > 2
    total = defaultdict(int)
    for r in out:
        total[r.doc_id] += r.n_tokens
    assert total == {i: len(t.split()) for i, t in text.items()}
    for shard in shards.values():
        rests = sorted((r for r in shard if r.n_tokens < 64), key=lambda r: (-r.n_tokens, r.doc_id))
        want = brute_best_fit([(r.n_tokens, source[r.doc_id], cluster[r.doc_id]) for r in rests], 64, 2)
        assert [(r.bin_id & 0xFFFFFFFF, r.start) for r in rests] == want
        full = [r.bin_id for r in shard if r.n_tokens == 64]
        assert len(full) == len(set(full)) and not set(full) & {r.bin_id for r in rests}


def test_packing_cases(spark):
    rows = [(1, "a b c d e f g"), (2, None), (3, ""), (4, "x y"), (4, "x y"), (None, "q")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumnRenamed("lang", "bin_id")
    out = packing.pack_documents(docs, capacity=3).collect()
    assert sorted((r.doc_id or 0, r.piece, r.n_tokens) for r in out) == [(0, 0, 1), (1, 0, 3), (1, 1, 3), (1, 2, 1), (2, 0, 0), (3, 0, 0), (4, 0, 2), (4, 0, 2)]
    assert all((r.bin_id is None) == (r.n_tokens == 0) for r in out)
    twins = [r.bin_id for r in out if r.doc_id == 4]
    assert twins[0] != twins[1]
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_near_copies_share_no_bin(spark):
    words = [f"w{i}" for i in range(100)]
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (0, 1, 2)]
    rows = [(1, " ".join(words)), (2, near[0]), (3, near[1]), (None, near[2]), (None, near[2].upper()), (4, "other words " * 50), (5, " ")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    out = [(r.doc_id, r.bin_id) for r in packing.pack_apart(docs).collect()]
    assert len(out) == 7 and (5, None) in out
    copies = [b for i, b in out if i in (None, 1, 2, 3)]
    assert len(copies) == len(set(copies)) == 5 and dict(out)[4] in copies
    assert packing.pack_apart(docs.limit(0)).count() == 0
