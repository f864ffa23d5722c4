"""Periodic runs, exact dedup and importance resampling against brute force, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.llm import exact, periodic, queries, resampling

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", " \n\t ", "a b c", "ab c", "a\x0bbc\r\n", "x y " * 40, "lead " + "p q r " * 9 + "p tail", "é 字 É " * 12, "un deux " * 3 + "trois", "w " * 6, "w " * 5, "A-B a_b 9x9 É", "one two " * 30 + "ONE Two",
    "a b a b " * 6,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a b c"), (3, "a b c"), (None, "abc"), (None, None), (-5, "x y " * 40), (None, "only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit(1) for c in ("row", "leaf", "norm", "block", "place", "runs", "rank", "score", "n", "sha", "part")})


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def parquet(spark, table):
    return spark.read.parquet(f"{SF}/{table}.parquet")


def brute_runs(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            a, n = i, j - i + q
            if j > i and n >= max(least, exponent * q) and not any(all(w[x] == w[x + r] for x in range(a, a + n - r)) for r in range(1, q)):
                out.append((a, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_small_words_equal_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        k, w = rng.choice([1, 2, 3, 6]), []
        for _ in range(rng.randint(0, 5)):
            w += ([rng.randrange(k) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7))[: rng.randint(1, 40)] + [rng.randrange(k) for _ in range(rng.randint(0, 4))]
        for least, exponent in ((6, 4), (2, 2), (10, 2), (1, 3)):
            assert periodic.find(np.array(w, np.int64), least, exponent) == brute_runs(w, least, exponent)


def test_runs_of_long_words():
    unary = np.zeros(30_000, np.int64)
    assert periodic.find(unary) == [(0, 30_000, 1)]
    rng = random.Random(2)
    base = [rng.randrange(9) for _ in range(40)] + [11]
    text = np.array(base * 300 + [77] + base * 200)
    assert [r for r in periodic.find(text) if r[2] > 9] == [(0, 12_300, 41), (12_301, 8_200, 41)]


def test_ordered_sets_split_and_keep_neighbours():
    rng = random.Random(3)
    numbers = rng.sample(range(10**6), 9000)
    kept, plain = periodic.Ordered(sorted(numbers[:3000])), sorted(numbers[:3000])
    for e in numbers[3000:]:
        left, right = max((x for x in plain[-1:] if x < e), default=None), None
        at = np.searchsorted(plain, e)
        left, right = plain[at - 1] if at else None, plain[at] if at < len(plain) else None
        assert kept.add(e) == (left, right)
        plain.insert(at, e)
    assert list(kept) == plain and len(kept) == 9000 and max(map(len, kept.parts)) <= periodic.Ordered.PART


def expected_runs(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    exponent = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, exponent, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query_equals_brute_force(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((expected_runs(*r) for r in rows_of(docs)), key=key)
    short = [r for r in rows_of(parquet(spark, "documents")) if len((r[1] or "").split()) < 500]
    want = {r[0]: expected_runs(*r) for r in short}
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == 1000 and sum(got[i] != want[i] for i in want) == 0 and sum(w[1] for w in want.values()) > 50
    assert periodic.runs(docs.limit(0)).count() == 0


def expected_groups(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d if d is not None else 0))
    out = Counter()
    for text, members in groups.items():
        members.sort()
        keep, sha = (None if members[0][1] else members[0][2]), hashlib.sha256(text.encode()).hexdigest()
        out.update((None if m[1] else m[2], keep, len(members), i == 0, sha) for i, m in enumerate(members))
    return out


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_exact_dedup_equals_brute_force(spark, docs, bits, monkeypatch):
    monkeypatch.setattr(exact, "BITS", bits)  # one to three levels over the leaves
    got = exact.verdicts(docs).drop("row")
    assert Counter(tuple(r) for r in got.collect()) == expected_groups(rows_of(docs))


def test_exact_dedup_of_a_hot_group_and_rows_that_stay(spark, docs):
    hot = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, concat('same ', repeat(' ', int(id % 7)), 'text'), concat('own ', id)) as text").repartition(40)
    got = exact.verdicts(hot).drop("row")
    assert Counter(tuple(r) for r in got.collect()) == expected_groups(rows_of(hot))
    stay = exact.distinct_texts(docs)
    assert stay.columns == docs.columns
    assert Counter(rows_of(stay)) == Counter({(d, t): 1 for d, t in [(1, ""), (2, " \n\t "), (5, "a\x0bbc\r\n")] if d != 1} | {r: 1 for r in rows_of(docs) if r[0] in {7, 8, 9, 10, 11, 12, 13, 14, -5}} | {(None, "only here"): 1})
    assert exact.verdicts(docs.limit(0)).count() == 0 and exact.distinct_texts(docs.limit(0)).count() == 0


def test_exact_dedup_plan_is_native(spark):
    plan = queries.op12_exact_dedup(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExternalRDD|CartesianProduct|NestedLoop", plan)


def test_exact_dedup_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = Counter(con.execute(queries.ORACLE["op12_exact_dedup"]).fetchall())
    assert Counter(tuple(r) for r in queries.op12_exact_dedup(spark, SF).collect()) == want


def features(text):
    words = FEATURE_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]  # noqa: B905


def expected_draw(rows, target, percent=25, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source, goal = Counter(), Counter(bucket(f) for t in target for f in features(t)[1])
    for _, t in rows:
        source.update(map(bucket, features(t)[1]))
    s, t = sum(source.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (s + 10000) / ((source[b] + 1) * (t + 10000))))
    out = []
    for d, text in rows:
        n, found = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return out


def test_resampling_equals_brute_force(spark, docs, monkeypatch):
    target = spark.createDataFrame([(1, "one two three"), (2, None), (3, "x y É")], "item_id long, text string")
    everything = [(docs, target, [r.text for r in target.collect()], 50, 3), (parquet(spark, "documents"), parquet(spark, "benchmark"), [r.text for r in parquet(spark, "benchmark").collect()], 25, 20)]
    monkeypatch.setattr(resampling, "BLOCK_BYTES", 200_000)  # several blocks a partition
    monkeypatch.setattr(resampling, "PART_BYTES", 300_000)
    for table, goal, texts, percent, least in everything:
        got = resampling.resample(table, goal, target_id="item_id", percent=percent, least_words=least)
        assert Counter(tuple(r) for r in got.collect()) == Counter(map(tuple, expected_draw(rows_of(table), texts, percent, least)))
    assert resampling.resample(docs.limit(0), target, target_id="item_id").count() == 0
    assert resampling.resample(docs, target.limit(0), target_id="item_id").count() == docs.count()


def test_packed_arrays_come_back():
    arrays = [np.array([], np.int64), np.array([3, 0, 255]), np.array([1 << 40]), np.array([-7, 5]), np.array([65536, 2])]
    for a, b in zip(arrays, resampling.unpack(resampling.pack(*arrays)), strict=True):
        assert a.tolist() == b.tolist()
