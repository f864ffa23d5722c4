"""Identity by bytes, rows and columns with clashing names, ties, empty tables, very long texts, and the models against brute force."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contactloom.llm import bagminhash, kernel, media, mixing, packing, quality_crf, quality_rules, secrets_scan, substring, token_rollup, toxicity
from contactloom.llm.common import fresh

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n, pair="ab"):
    """Two words that every polynomial hash modulo 2**64 confuses from 1024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(pair[b] for b in bits), "".join(pair[1 - b] for b in bits)


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[k], t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(enumerate(texts))], COLUMNS)


def test_words_that_polynomials_confuse_are_told_apart(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    for n in (1024, 2048):
        a, b = thue_morse(n)
        c = next(kernel.chunks(pa.array([f"{a} {b} {a}"])))
        assert len(set(c.hashes().tolist())) == len(set(c.hashes(1).tolist())) == 2 and c.numbers()[1].tolist() in ([0, 1, 0], [1, 0, 1])
        got = {r.doc_id: r.ids_crc32 for r in packing.pack(table(spark, [a, b])).collect()}
        for i, t in enumerate((a, b)):
            ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
            assert got[i] == zlib.crc32(np.array(ids, "<u4").tobytes())
        text = f"{a}\n{b}\n{a} x y z q\n{b} x y z q"
        s = quality_rules.statistics(next(kernel.chunks(pa.array([text]))))
        assert s["n_dup_lines"][0] == 0 and s["n_repeat_words"][0] == 0
        # texts of 1024 words, in the same pattern
        words = [" ".join(t).replace("a", "one").replace("b", "two") for t in (a, b)]
        assert {r.doc_id: r.class_id for r in bagminhash.classes(table(spark, [a, b, *words[:1]])).collect()} == {0: 0, 1: 1, 2: 2}
        assert len({tuple(kernel.sequence_hash(x.hashes(k), x.bounds, k)[0] for k in (0, 1)) for x in (next(kernel.chunks(pa.array([w]))) for w in words)}) == 2


def test_numbers_fall_back_to_bytes_if_hashes_meet():
    c = next(kernel.chunks(pa.array(["aa bb aa cc " + "d" * 80 + " " + "e" * 80])))
    first, number = kernel.numbers(c.data, *c.words, np.zeros(6, np.uint64))
    assert number.tolist() == [0, 1, 0, 2, 3, 4] and first.tolist() == [0, 1, 3, 4, 5]


CLASH = ("_id", "_k", "_n", "_at", "key", "id", "n", "rep", "h", "file", "row", "bucket", "mix_key", "mix_at", "dedup_key", "text_", "at", "score", "order")


def test_pipeline_stages_keep_all_columns_and_rows(spark):
    text = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdefg"]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (3, text[2]), (3, text[3]), (4, text[2]), (None, None), (5, ""), (6, text[4]), (6, text[4])]
    docs = spark.createDataFrame([(d, t, "en", None if k % 3 else "s", len(t or ""), k) for k, (d, t) in enumerate(rows)], COLUMNS + ", tag long").withColumns({c: F.col("tag") + 100 for c in CLASH})
    one = corpus_pipeline.near_dedup(spark, docs, SF)
    got = one.collect()
    assert one.columns == docs.columns and all(r[c] == r.tag + 100 for r in got for c in CLASH)
    assert Counter((r.doc_id, r.text or "") for r in got) == Counter([(None, text[0]), (None, text[1]), (3, text[2]), (3, text[3]), (5, ""), (6, text[4])])
    for stage in (corpus_pipeline.secrets, corpus_pipeline.mix):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert Counter(r.doc_id for r in packed.collect()) == Counter(d for d, _ in rows)
    assert fresh(docs, "KEY", "free") == ["KEY_", "free"]


def test_stages_of_an_empty_table_are_empty(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns and not stage(spark, docs, SF).count()
    assert not corpus_pipeline.pack(spark, docs, SF).count()
    model = quality_rules.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert not quality_rules.score(docs, model).count() and not token_rollup.count_tokens(docs).count()


def test_mixing_decides_the_packed_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i} " * 30, "en", "ab"[i % 10 == 0], 90) for i in range(400)], COLUMNS)
    order = {}
    for name, df in (("mixed", mixing.mixed(docs, weights={"a": 0.5, "b": 0.5}, block=256)), ("plain", docs.coalesce(1))):
        df.write.parquet(f"file://{tmp_path}/{name}")
        packed = corpus_pipeline.pack(spark, spark.read.parquet(f"file://{tmp_path}/{name}"), SF).collect()
        order[name] = [r.doc_id for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset))]
    share = {k: sum(i % 10 == 0 for i in v[:60]) / 60 for k, v in order.items()}
    assert share["mixed"] > 0.35 and share["plain"] < 0.2


def test_ties_in_the_mix_and_many_sources(spark):
    docs = spark.createDataFrame([(1, "same", "en", "s", 4)] * 6 + [(i, "x" * 50, "en", f"s{i}", 50) for i in range(300)], COLUMNS)
    got = mixing.mix(docs, block=16).collect()
    assert len(got) == 306 and len({(r.slot, r.place) for r in got if r.source != "s"}) == 300
    for w in ([1 / 3] * 3, [0.0001, 0.9999], [2**0.5, 3**0.5, 1.0]):
        plan = mixing.phases([4000] * len(w), w)[0]["sources"]
        served = np.zeros((len(w), max(int(s[2].max()) for s in plan.values() if len(s[2])) + 1))
        for i, (_, _, slots) in plan.items():
            served[i, slots] = 1
        t = np.arange(1, served.shape[1] + 1)
        for i, x in enumerate(w):
            assert np.abs(np.cumsum(served[i]) - t * x / sum(w)).max() < 1 + 1e-9


def test_forward_backward_equals_all_label_paths():
    rng = np.random.default_rng(0)
    score, bounds, trans, start = rng.normal(size=9), np.array([0, 4, 4, 9]), rng.normal(size=(2, 2)), rng.normal(size=2)
    p, pair, first = quality_crf.forward_backward(score, bounds, trans, start)
    want, pairs, firsts = np.zeros(9), np.zeros((2, 2)), np.zeros(2)
    for a, b in ((0, 4), (4, 9)):
        paths = list(itertools.product((0, 1), repeat=b - a))
        mass = np.array([np.exp(start[y[0]] + sum(score[a + i] * y[i] for i in range(b - a)) + sum(trans[y[i - 1], y[i]] for i in range(1, b - a))) for y in paths])
        for y, m in zip(paths, mass / mass.sum(), strict=True):
            want[a:b] += m * np.array(y)
            firsts[y[0]] += m
            for i in range(1, b - a):
                pairs[y[i - 1], y[i]] += m
    assert np.allclose(p, want) and np.allclose(pair, pairs) and np.allclose(first, firsts)


def test_classifier_equals_sums_over_single_ngrams():
    rng = np.random.default_rng(1)
    model = quality_rules.Model(rng.normal(size=3 * quality_rules.SIZE).astype(np.float32), 0.25, (1.5, -0.5))
    weight = lambda text, block: model.weights[quality_rules.ngrams(next(kernel.chunks(pa.array([text]))))[block][0]]
    texts = ["Ein  grüner Wald", "a b\nc", "字é", "x", "", None, "one two one two"]
    got = np.concatenate([model.score(c) for c in kernel.chunks(pa.array(texts))])
    for t, g in zip(texts, got, strict=True):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        blocks = [[weight(w, 0)[0] for w in words], [weight(" ".join(p), 1)[0] for p in itertools.pairwise(words)], [weight(t[i : i + 3], 2)[0] for i in range(len(t) - 2)]]
        raw = 0.25 + sum(float(np.mean(b)) for b in blocks if b)
        assert abs(g - 1 / (1 + np.exp(-(1.5 * raw - 0.5)))) < 1e-5


def test_quality_rules_learn_planted_words(spark):
    rows = [(i, f"{'fine' if i % 2 else 'junk'} text number {i} with ten words in it here", "en", "s", 1) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, COLUMNS)
    got = quality_rules.score(docs, quality_rules.fit(docs, labels)).where("doc_id >= 160").collect()
    assert all(r.kept == bool(r.doc_id % 2) for r in got)


def test_lexicon_hits_equal_naive_search(spark):
    lexicon = toxicity.Lexicon({" vile ": 2.0, " scum": 1.5, " scumbag ": 3.0, " rot": 0.5}, ("pond scum", "rot proof paint"))
    parts = ["vile", "scum", "scumbag", "rotten", "pond", "proof", "paint", "rot", "calm", "V1LE", "ｖｉｌｅ", "sсum"]
    rng = np.random.default_rng(2)
    for _ in range(300):
        text = " ".join(rng.choice(parts, 12))
        folded = toxicity.fold(text)
        calm = [(m.start(), m.start() + len(p) + 2) for p in lexicon.exceptions for m in re.finditer(f"(?= {p} )", folded)]
        best = {}
        for p, w in lexicon.weights.items():
            for m in re.finditer(f"(?={p})", folded):
                if not any(a <= m.start() and m.start() + len(p) <= b for a, b in calm):
                    best[m.start()] = max(w, best.get(m.start(), 0))
        n, weight, words = lexicon.measure(folded)
        assert (n, words) == (len(best), 12) and abs(weight - sum(best.values())) < 1e-9


def test_innocent_contexts_become_exceptions(spark):
    rows = [(i, f"you are a zapper filler{i}") for i in range(100)] + [(i, f"the bug zapper works filler{i}") for i in range(100, 110)] + [(i, f"calm words filler{i}") for i in range(110, 300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i < 100)) for i in range(300)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels, exceptions=())
    assert lexicon.measure(toxicity.fold("mean zapper"))[0] == 1 and lexicon.measure(toxicity.fold("mean bug zapper works"))[0] == 0


def test_exactly_the_rows_at_similarity_are_joined(spark):
    """Recall of links at 0.8 and above, over pairs on both sides of it."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(100)]
        near = list(base)
        for i in rng.choice(100, rng.integers(1, 5), replace=False):
            near[i] = f"new{g}_{i}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(near))]
    bags = [Counter(tuple(t.split()[i : i + 5]) for i in range(96)) for _, t in rows]
    want = {g for g in range(60) if 5 * sum((bags[2 * g] & bags[2 * g + 1]).values()) >= 4 * sum((bags[2 * g] | bags[2 * g + 1]).values())}
    classes = {r.doc_id: r.class_id for r in bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = {g for g in range(60) if classes[2 * g] == classes[2 * g + 1]}
    assert 10 < len(want) < 55 and got == want


@pytest.fixture(scope="module")
def long_text():
    rng = np.random.default_rng(7)
    words = [f"word{i}" for i in range(5000)]
    lines = [" ".join(rng.choice(words, 12)) for _ in range(25_000)]
    return "\n".join([*lines, "key zq9Kf83hTTpLw0Xv7RbN2mYs end", *lines[:50]])


def test_very_long_texts(spark, long_text):
    """A text of 2 MB beside a short one, through every operator."""
    docs = table(spark, [long_text, "short"])
    n = len(long_text.split())
    assert {r.doc_id: r.n_words for r in quality_rules.score(docs, quality_rules.Model(np.zeros(3 * quality_rules.SIZE, np.float32), 0.0, (1.0, 0.0))).collect()} == {0: n, 1: 1}
    field = quality_crf.Field(np.zeros(28), np.zeros((2, 2)), np.zeros(2))
    assert {r.doc_id: r.n_lines for r in quality_crf.score(docs, field).collect()} == {0: 25_051, 1: 1}
    assert {r.doc_id: r.n_words for r in toxicity.score(docs, toxicity.Lexicon({" word7 ": 1.0})).collect()} == {0: n, 1: 1}
    assert "novel" in secrets_scan.scan(docs).where("doc_id = 0").first().spans
    assert substring.dedup(docs).where("doc_id = 0").first().n_removed >= 600
    assert bagminhash.classes(docs).select("class_id").distinct().count() == 2
    assert packing.pack(docs).where("doc_id = 0").agg(F.sum("length")).first()[0] > n
    assert mixing.mix(docs).count() == 2 and token_rollup.count_tokens(docs).agg(F.sum("n_words")).first()[0] == n + 1
    row = media.media(docs).where("doc_id = 0").drop("rgb").first()
    assert row.n_bytes == len(long_text) and row.payload_bytes % 192 == 0


def colliding_words(n):
    """Pairs of different 16-letter words with one hash in lane 0: the second block is solved for."""
    rng, out, lane, odd = np.random.default_rng(4), [], 0, kernel.LANES[0]
    begin = kernel.mix(np.array([17], np.uint64) * odd)[0]
    state = lambda block: kernel.mix((begin ^ block) * odd)
    letters = lambda m: rng.integers(97, 123, (m, 8), np.uint8)
    while len(out) < n:
        a, b, tail = letters(50_000), letters(50_000), letters(50_000)
        other = (state(a.view("<u8")[:, 0]) ^ state(b.view("<u8")[:, 0]) ^ tail.view("<u8")[:, 0]).view(np.uint8).reshape(-1, 8)
        for i in np.flatnonzero(((other > 32) & (other < 127)).all(1)):
            out.append(((a[i].tobytes() + tail[i].tobytes()).decode(), (b[i].tobytes() + other[i].tobytes()).decode()))
    assert lane == 0
    return out[:n]


def test_texts_of_colliding_words_are_not_near_copies(spark):
    pairs = colliding_words(12)
    one, two = (" ".join(p[k] for p in pairs) for k in (0, 1))
    data = np.frombuffer(f"{pairs[0][0]} {pairs[0][1]}".encode(), np.uint8)
    h = kernel.span_hash(data, np.array([0, 17]), np.array([16, 33]))
    assert h[0] == h[1] and not set(one.split()) & set(two.split())
    table = spark.createDataFrame([(1, one), (2, two), (3, one + " more")], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in bagminhash.classes(table).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    members = [{"rep": i, "root": i, "bag": b} for i, b in enumerate(bagminhash.expanded(next(kernel.chunks(pa.array([one, two, one + " more"])))))]
    kind = pa.list_(pa.struct([("rep", pa.int64()), ("root", pa.int64()), ("bag", pa.binary())]))
    found = bagminhash._compare(pa.RecordBatch.from_arrays([pa.array([members], kind)] * 2, names=["some", "all"]))
    assert set(zip(found["a"].tolist(), found["b"].tolist(), strict=True)) == {(0, 2)}


def test_rows_without_an_id_are_documents_of_their_own_in_substring_dedup(spark):
    passage = " ".join(f"p{j}" for j in range(25))
    own = lambda i: " ".join(f"x{i}y{j}" for j in range(6))
    rows = [(None, f"{own(i)} {passage} {own(i)}z") for i in range(400)] + [(None, f"{own(0)} {passage} {own(0)}z"), (None, None), (None, ""), (4, f"{passage} {own('a')}"), (np.iinfo(np.int64).min, own("b"))]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), with_text=True).collect()
    assert len(got) == len(rows)
    free = [r for r in got if r.doc_id is None]
    whole = [r for r in free if passage in r.kept_text]
    # one text keeps the passage; it may be the one that stands twice
    assert len({r.kept_text for r in whole}) == 1 and all(r.n_removed == 0 for r in whole)
    assert all(r.n_removed == 25 for r in free if r.n_words and r not in whole)
    assert [r.n_removed for r in got if r.doc_id is not None] == [25, 0] or [r.n_removed for r in got if r.doc_id is not None] == [0, 25]
    assert {r.doc_id: r.n_removed for r in got if r.doc_id is not None} == {4: 25, np.iinfo(np.int64).min: 0}
