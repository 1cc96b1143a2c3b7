"""Learned operators by held-out accuracy, scans and links against brute force, and the pipeline stage by stage."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from kinfold.llm import langid, licences, quality, quotes
from kinfold.llm import queries as Q
from kinfold.llm.common import ascii_words

from .test_exact import DOCS, brute_components, brute_contamination, brute_repeats

SF = "/root/testdata/sf0.01"


def test_op3_held_out_accuracy(spark):
    import zlib

    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.op3_language_id(spark, SF).collect()
    assert len(got) == len(want)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in want if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and (r.lang_pred in {"de", "en", "es", "fr"} or r.lang_pred == "und") for r in got)


def brute_language(model, text):
    """Word by word, in plain Python, from the tables of a model."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words or not model.langs:
        return "und", 0.0
    total = [0.0] * len(model.langs)
    for word in words:
        row = [0.0] * len(total)
        if word in model.words.number:
            row = model.words.logs[model.words.number[word]]
        else:
            for size in (4, 3, 2, 1):
                padded = f"^{word}$" if size > 1 else word
                table = model.grams[size - 1]
                known = [table.logs[table.number[g]] for g in (padded[i : i + size] for i in range(len(padded) - size + 1)) if g in table.number]
                if known:
                    row = [sum(c) / len(known) for c in zip(*known, strict=True)]
                    break
        total = [x + y for x, y in zip(total, row, strict=True)]
    share = [np.exp(x - max(total)) for x in total]
    return model.langs[share.index(max(share))], max(share) / sum(share)


def test_op3_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit_language_model(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").select("doc_id", "text", "lang"))
    want = {r.doc_id: brute_language(model, r.text) for r in docs.collect()}
    for r in Q.op3_language_id(spark, sf_dir).collect():
        assert r.lang_pred == want[r.doc_id][0] and np.isclose(r.score, want[r.doc_id][1], atol=1e-6)


def test_language_backoff_and_cases(spark):
    train = spark.createDataFrame([(1, "hello " * 5 + "there " * 3, "aa"), (2, "Hola " * 5 + "senor, senor", "bb"), (3, None, "cc"), (4, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit_language_model(train)
    assert model.langs == ["aa", "bb"]
    assert model.predict(["Hello there", "holas SENORA"]) == [brute_language(model, t) for t in ("Hello there", "holas SENORA")]
    assert [x[0] for x in model.predict(["Hello there", None, "holas SENORA"])] == ["aa", "und", "bb"]
    # An unseen word is scored by its longest known n-grams only: "^hol" is known, so shorter ones do not enter.
    assert np.allclose(model.unseen(["holzz"])[0], model.grams[3].logs[model.grams[3].number["^hol"]])
    assert model.predict(["中文"]) == [("aa", 0.5)]
    assert model.predict([None, "12 !?"]) == [("und", 0.0)] * 2
    docs = spark.createDataFrame([(1, None), (None, "hello"), (2, ""), (2, "hola"), (2, "hola " * 9000)], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.lang_pred) for r in langid.identify_language(docs, model).collect())
    assert out == [(0, "aa"), (1, "und"), (2, "bb"), (2, "bb"), (2, "und")]
    empty = langid.fit_language_model(train.filter("text is null or lang is null"))
    assert empty.predict(["hello"]) == [("und", 0.0)]


def test_rare_language_keeps_its_words(spark):
    rows = [(i, " ".join(f"common{k} shared" for k in range(i, i + 30)), "en") for i in range(9)] + [(10, "zzqa zzqb zzqc shared", "xx")]
    model = langid.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_words=8, max_grams=32)
    assert model.langs == ["en", "xx"] and {"zzqa", "zzqb", "zzqc", "shared"} <= set(model.words.number) and len(model.words.number) <= 8
    assert model.words.logs[model.words.number["shared"]][0] > model.words.logs[model.words.number["zzqa"]][0]
    assert [x[0] for x in model.predict(["zzqa zzqb", "common1 common2"])] == ["xx", "en"]


def test_op4_held_out_accuracy(spark):
    import zlib

    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = Q.op4_quality(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(r.score, label[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in label]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in got)
    assert sum(y == p for _, y, p in held) >= 0.9 * len(held)
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good]) > 0.95


def test_factorisation_identity():
    model = quality.FactorisationMachine(bits=4, rank=3)
    model.w[:] = np.random.default_rng(1).normal(size=len(model.w))
    slots, values = quality.features(b"A few words, A FEW\nwords", 23, 4)
    margin, _ = model.margins(slots, values, np.array([0]))
    pairs = sum(float(model.v[i] @ model.v[j]) * x * y for a, (i, x) in enumerate(zip(slots, values)) for j, y in list(zip(slots, values))[a + 1 :])
    assert np.isclose(margin[0], float(model.w[slots] @ values) + pairs, atol=1e-4)


def test_quality_cases(spark):
    rows = [(1, "good plain words here", None, None, 21), (2, "BAD!! BAD!! BAD!!", None, None, None), (3, None, None, None, None), (None, "", None, None, 0), (1, "good plain words here", None, None, 21)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit_quality_model(docs, labels)
    out = quality.score_quality(docs, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.score_quality(docs.drop("n_chars"), None).collect()} == {0.5}
    assert quality.fit_quality_model(docs, labels.limit(0)) is None
    assert quality.keep_good(docs.limit(0), model).columns == docs.columns
    assert quality.keep_good(docs, None, 0.7).count() == 0


def brute_statistics(machine, templates, ids):
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for k in range(1, len(ids) + 1):
        yield max([n for n in range(0, k + 1) if not n or tuple(ids[k - n : k]) in runs])


@pytest.mark.parametrize("seed", range(5))
def test_suffix_automaton(seed):
    rng = np.random.default_rng(seed)
    made = {f"t{k}": [" ".join(rng.choice(list("abc"), int(rng.integers(1, 14))))] for k in range(4)}
    made["t1"] += made["t3"]
    machine = licences.LicenceAutomaton(made)
    texts = [[machine.vocabulary[w] for w in ascii_words(x.encode())] for k in sorted(made) for x in made[k]]
    ids = rng.integers(0, len(machine.vocabulary), 60).tolist()
    stats = machine.matching_statistics(ids)
    assert [n for _, n in stats] == list(brute_statistics(machine, texts, ids))
    for k, (state, n) in enumerate(stats):
        if n:
            run = ids[k + 1 - n : k + 1]
            assert machine.ends[state] == [(t, e) for t, x in enumerate(texts) for e in range(n, len(x) + 1) if x[e - n : e] == run]


def brute_phrases(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_op8(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.op8_licences(spark, SF).collect()
    assert len(got) == len(docs) and any(r.n_base for r in got)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_phrases(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_licence_cases(spark):
    apache, mit = licences.TEMPLATES["apache"][0], licences.TEMPLATES["mit"][0]
    edited = mit.replace("without restriction, including", "without any limit at all, including").replace("sublicense", "sub-license")
    rows = [(1, f"/* x */ {edited} int main"), (2, None), (3, ""), (4, "MIT license mit LICENSE"), (5, apache + " ... " + mit), (6, "the of and to in this any for a"), (4, "MIT license mit LICENSE"), (None, "mit license")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, labels string")
    out = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    (span,) = out[1].spans
    assert out[1].labels == "mit" and out[1].n_base == 0 and 0.8 < out[1].score < 1 and span.start == 1 and span.end == out[1].n_words - 2
    assert (out[2].n_words, out[2].labels, out[2].first_word, out[2].score) == (0, "", None, 0.0) and out[3].base_labels == ""
    assert (out[4].n_base, out[4].first_word, out[4].last_word, out[4].labels, out[4].score) == (2, 0, 2, "mit", 1.0)
    assert out[5].labels == "apache,mit" and out[5].base_labels == "apache" and out[6].labels == "" and out[None].n_base == 1
    assert licences.scan_licences(docs).count() == 8 and licences.scan_licences(docs.limit(0)).count() == 0


def brute_chains(templates, words, least, gap):
    """Best covered share of each template: every maximal run, and every order-keeping chain of runs."""
    out = []
    for label in sorted(templates):
        for text in templates[label]:
            t = [w.encode() for w in text.split()]
            runs = set()
            for i in range(len(words)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                        n += 1
                    # Longest in any template that ends here, as matching statistics give them.
                    if n >= least and not (i and j and words[i - 1] == t[j - 1]):
                        runs.add((i, j, n))
            best = {}

            def cover(run):
                if run not in best:
                    i, j, n = run
                    best[run] = n
                    for other in runs:
                        a, b, m = other
                        new = n - max(0, a + m - i, b + m - j)
                        if a < i and j + n > b + m and new > 0 and i - a - m <= gap and j - b - m <= gap:
                            best[run] = max(best[run], cover(other) + new)
                return best[run]

            if runs:
                out.append((label, min(1.0, max(map(cover, runs)) / len(t))))
    return out


def test_chains_equal_brute_force():
    """Templates without shared runs, so that every maximal run of one is one of the matching statistics."""
    rng = np.random.default_rng(4)
    for seed in range(30):
        made = {f"t{k}": [" ".join(f"{k}w{int(x)}" for x in rng.permutation(40))] for k in range(3)}
        doc = []
        for _ in range(6):
            t = made[f"t{int(rng.integers(0, 3))}"][0].split()
            a = int(rng.integers(0, 30))
            doc += t[a : a + int(rng.integers(2, 14))] + [f"x{int(x)}" for x in rng.integers(0, 9, int(rng.integers(0, 5)))]
        words = [w.encode() for w in doc]
        got = [(c[0], c[3]) for c in licences.LicenceAutomaton(made).chains(words, 3, 6)]
        assert [x[0] for x in got] == [x[0] for x in brute_chains(made, words, 3, 6)]
        assert np.allclose([x[1] for x in got], [x[1] for x in brute_chains(made, words, 3, 6)])


def test_whole_licences_are_found(spark):
    rows = [(n, f"Copyright 2020 someone {text}", label) for n, (label, text) in enumerate((k, x) for k, v in licences.TEMPLATES.items() for x in v)]
    out = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()}
    for n, _, label in rows:
        assert label in out[n].labels.split(",") and out[n].score == 1.0


def test_chains_reach_past_many_runs():
    head, tail, often = "x1 x2 x3 x4 x5", "y1 y2 y3 y4 y5", "r1 r2 r3 r4 r5"
    template = " ".join([head, tail, *(f"p{i}" for i in range(20)), *(f"{often} q{i}" for i in range(80))])
    machine = licences.LicenceAutomaton({"t": [template]})
    ((_, start, end, cover),) = machine.chains(ascii_words(f"{head} {often} {tail}".encode()), 5, 12)
    assert (start, end) == (0, 15) and np.isclose(cover, 10 / len(template.split()))


def brute_quotes(rows):
    def norm(t):
        return re.sub(r"\s+", " ", t.lower()).strip(" ")

    parsed = []
    for conv, turn, role, text in rows:
        passages = []
        for line in re.split("\r?\n", text or ""):
            marks = re.match("((?:[ \t]*>)*)", line)[1]
            level, body = marks.count(">"), re.sub("^(?:[ \t]*>)+[ \t]?", "", line)
            if passages and passages[-1][0] == level:
                passages[-1][1] += "\n" + body
            else:
                passages.append([level, body])
        own = re.sub(r"\A\s+|\s+\Z", "", "\n".join(b for n, b in passages if not n))
        parsed.append((conv, turn, role, own, passages))
    first = {}
    for conv, turn, _, own, passages in parsed:
        if conv is not None and turn is not None:
            for piece in [own, *(b for n, b in passages if not n), *re.split(r"\n\s*\n", own), *own.split("\n")]:
                if norm(piece):
                    first[conv, norm(piece)] = min(turn, first.get((conv, norm(piece)), turn))
    parents, counts = {}, {}
    for conv, turn, _, _, passages in parsed:
        if conv is None or turn is None:
            continue
        links = {(n, norm(b)) for n, b in passages if n and norm(b)}
        found = [(n, -first[conv, p]) for n, p in links if (conv, p) in first and first[conv, p] < turn]
        counts[conv, turn] = (len(links), len(found))
        parents[conv, turn] = -min(found)[1] if found else None
    for conv, turn, role, own, passages in parsed:
        top, depth, parent = turn, 0, parents.get((conv, turn))
        while conv is not None and top is not None and parents.get((conv, top)) is not None:
            top, depth = parents[conv, top], depth + 1
        yield (conv, turn, role, own, max(n for n, _ in passages), *counts.get((conv, turn), (0, 0)), parent, top, depth)


def quoted_rows():
    return [
        (1, 0, "user", "Where is it?\nTell me."),
        (1, 1, "assistant", "> Where is it?\n> Tell  ME.\nHere, on the left."),
        (1, 2, "user", "> > where is it? tell me.\n> Here, on the left.\n\nThanks\r\n\r\nA lot"),
        (1, 3, "assistant", ">> here, on the left.\n>thanks\nBye"),
        (1, 4, "user", " > A lot\ninline\n> nothing like this\n>\n> bye"),
        (1, 5, "user", "> Where is it?\nlate"),
        (2, 0, "user", "> Bye\nother conversation"),
        (2, 1, "user", None),
        (2, 2, "user", ""),
        (None, 3, "user", "> other conversation"),
        (2, None, "user", "> other conversation"),
        *((3, n, "user", f"hi all\n> hi all\n> m{n - 1}\nm{n}") for n in range(40)),
    ]


def test_quote_links(spark):
    rows = quoted_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    key = lambda r: str(r)
    got = sorted((tuple(r) for r in quotes.link_quotes(df).collect()), key=key)
    assert got == sorted(brute_quotes(rows), key=key)
    assert max(r[-1] for r in got) == 39 and {r[1]: r[7] for r in got if r[0] == 1} == {0: None, 1: 0, 2: 1, 3: 2, 4: 2, 5: 0}
    twice = quotes.link_quotes(df.unionByName(df))
    assert sorted((tuple(r) for r in twice.distinct().collect()), key=key) == sorted(set(got), key=key) and twice.count() == 2 * len(rows)
    assert quotes.link_quotes(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_quoted_threads(spark, seed):
    """Replies that quote whole messages, paragraphs or lines of earlier ones, at several levels, among quotes of nothing."""
    rng = np.random.default_rng(seed)
    rows, word = [], iter(range(10**6))
    for conv in range(12):
        own = []
        for turn in range(int(rng.integers(1, 25))):
            lines = []
            for _ in range(int(rng.integers(0, 4)) if own else 0):
                level = ">" * int(rng.integers(1, 4))
                source, plain = own[int(rng.integers(0, len(own)))]
                pick = [source if plain else source.split("\n\n")[-1], source.split("\n\n")[0], source.split("\n")[-1], f"nothing said {next(word)}"][int(rng.integers(0, 4))]
                lines += [f"{level} {x.upper() if rng.random() < 0.3 else x}" for x in pick.split("\n")] + [f"reply {next(word)}"]
            paragraphs = ["\n".join(f"line {next(word)}  of {turn}" for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(1, 4)))]
            own.append(("\n\n".join(paragraphs), not lines))
            rows.append((conv, turn, "user", "\n".join([*lines, *([""] if lines else []), own[-1][0]])))
    got = sorted(map(tuple, quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    assert got == sorted(brute_quotes(rows)) and sum(r[7] is not None for r in got) > len(rows) / 4 and max(r[9] for r in got) > 2


def test_long_quote_is_linear(spark):
    text = "\n".join(f"{'> ' * (k % 2)}line {k}" for k in range(20_000))
    row = quotes.link_quotes(spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string")).first()
    assert row.n_quotes == 10_000 and row.quote_level == 1 and row.n_linked == 0


def test_partial_quotes(spark):
    rows = [
        (1, 0, "First thing.\n\nSecond\nthing here.\n\nThird thing."),
        (1, 1, "alpha one\nbeta two\ngamma three\ndelta four"),
        (1, 2, "> First thing.\n>\n> third  THING.\nTwo of three paragraphs"),
        (1, 3, "> alpha one\n> beta two\nLines 1-2 of 4"),
        (1, 4, "> First thing.\n>\n> alpha one\n> beta two\n>\n> Second\n> thing here.\nof two messages"),
        (1, 5, "> gamma three\n> [...]\n> delta four\nwith a line of its own"),
        (1, 6, "> alpha one\n> not said\n\n> Third thing.\na quote found in part counts after whole ones"),
        (1, 7, ">> alpha one\n>> delta four\n> First thing.\n> not said\n> two of three paragraphs\ntwo levels"),
        (1, 8, "> not said at all\n> nor this\nnothing"),
        (2, 1, "> alpha one\n> beta two\nother conversation"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.parent_turn, r.thread_turn, r.depth) for r in quotes.link_quotes(df.unionByName(df)).collect()}
    assert got == {
        (1, 0): (0, 0, None, 0, 0), (1, 1): (0, 0, None, 1, 0), (1, 2): (1, 1, 0, 0, 1), (1, 3): (1, 1, 1, 1, 1), (1, 4): (1, 1, 0, 0, 1),
        (1, 5): (1, 1, 1, 1, 1), (1, 6): (2, 1, 0, 0, 1), (1, 7): (2, 1, 1, 1, 1), (1, 8): (1, 0, None, 8, 0), (2, 1): (1, 0, None, 1, 0),
    }


def test_op9(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, Q.op9_quote_links(spark, sf_dir).collect())) == sorted(brute_quotes(rows))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = [docs]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "repeated passages", "benchmark decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES:
        made.append(corpus_pipeline.materialise(stage(spark, made[-1], sf_dir), "test"))
    rows = [{r.doc_id: r for r in d.collect()} for d in made[:-1]]
    assert all(d.columns == docs.columns for d in made[:-1])
    scored = {r.doc_id: r.predicted for r in Q.op4_quality(spark, sf_dir).collect()}
    assert set(rows[1]) == {i for i, p in scored.items() if p} and all(rows[1][i] == rows[0][i] for i in rows[1])
    kept = brute_components([(i, r.text) for i, r in rows[1].items()], 5, 80)
    assert set(rows[2]) == {d for d, _, _, k in kept if k} and all(rows[2][i] == rows[0][i] for i in rows[2])
    cut = {d: (n, gone, h) for d, n, gone, _, h in brute_repeats([(i, r.text) for i, r in rows[2].items()])}
    assert set(rows[3]) == {d for d, (n, gone, _) in cut.items() if not n or gone < n}
    for i, r in rows[3].items():
        if not cut[i][1]:
            assert r == rows[2][i]
        else:
            assert r.n_chars == len(r.text) and (hashlib.sha256(r.text.encode()).hexdigest() == cut[i][2] or len(r.text.encode()) >= cut[i][0] - cut[i][1] - 6)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(rows[4]) == {r[0] for r in brute_contamination([(i, r.text) for i, r in rows[3].items()], items) if not r[5]}
    total = defaultdict(int)
    for r in made[-1].collect():
        total[r.doc_id] += r.n_tokens
    assert dict(total) == {i: len(r.text.split()) for i, r in rows[4].items()}
