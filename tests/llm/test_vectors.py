"""Hard negatives and vector codes against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from palisade.llm import hard_negatives, queries, vector_codes
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cell long, block long, code string, error long"


def odd_vectors(spark, dims, n=260, seed=3):
    """Rows with ties, repeated and null ids, labels and components; one label has half of the rows, one vector a third."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [0.25] * dims if i % 3 == 0 else [rng.choice([-0.5, -0.25, 0.0, 0.125, 0.3, 0.7]) + rng.random() / 64 for _ in range(dims)]
        rows.append((i * 5, x, 1 if i % 2 else rng.choice([0, 2, 3, 9, None])))
    rows[7] = (35, None, 1)
    rows[8] = (40, [None] + [0.1] * (dims - 1), 1)
    rows[9] = (45, [float("nan")] + [0.1] * (dims - 1), 1)
    rows[11] = (55, [float("inf")] + [0.1] * (dims - 1), 1)
    rows[12] = (60, [], 1)
    rows[13] = (65, [0.5] * (dims + 1), 1)
    rows[14] = (None, [0.5] * dims, 1)
    rows += [rows[20], rows[21], rows[40]]
    return rows, spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA)


def whole(rows, dims):
    keep = [r for r in rows if r[1] is not None and len(r[1]) == dims and all(c is not None and np.isfinite(c) for c in r[1])]
    return [(i, tuple(int(np.floor(256 * np.float64(np.float32(c)))) for c in x), label) for i, x, label in keep]


def brute_negatives(rows):
    rows = {r for r in rows if r[0] is not None and r[2] is not None}
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in sorted(rows)]
    out = []
    for a, v, label in rows:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, w, other in rows if i != a)
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            hard = [s for s in scored if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:10]
            out += [(a, p, rank, i, -ps, -ns) for rank, (ns, i, _) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("dims, block, probe", [(16, 1024, 64), (7, 16, 1), (1, 16, 1)])
def test_hard_negatives(spark, monkeypatch, dims, block, probe):
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "MOST_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "PROBE", probe)
    monkeypatch.setattr(hard_negatives, "QUERIES", 4)
    rows, df = odd_vectors(spark, dims)
    want = brute_negatives(whole(rows, dims))
    got = hard_negatives.mine(df, relabel=7)
    assert sorted(map(tuple, got.collect())) == want and want
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_nothing(spark):
    _, df = odd_vectors(spark, 4)
    assert hard_negatives.mine(df.filter("false")).collect() == []
    assert hard_negatives.mine(df.filter("label is null")).collect() == []
    assert hard_negatives.mine(df.filter("vec_id % 100 != 0")).collect() == []
    one = df.filter("vec_id = 100").withColumn("label", df["label"] * 0)
    assert hard_negatives.mine(one).collect() == []


def test_cells_are_visited_by_falling_bounds():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(-9, 9, rng.integers(1, 9)).astype(float), rng.integers(-9, 9, rng.integers(1, 9)).astype(float)
        rows = rng.integers(0, 3, len(a) * len(b))
        index = hard_negatives.HalfIndex((a[:, None], b[:, None]), (a, b), rows, rows, rows)
        seen = list(index.visit(a, b))
        assert sorted(c for _, c in seen) == np.flatnonzero(rows).tolist()
        assert [s for s, _ in seen] == sorted((s for s, _ in seen), reverse=True)
        assert all(s == a[c // len(b)] + b[c % len(b)] for s, c in seen)


def test_bounds_hold_and_spare_cells(spark):
    """Far groups of rows: each row stays within its cell's bound, and a query does not visit the others' cells."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(8, 12)) * 3
    rows = [(i, [float(c) for c in centre[i % 8] + rng.normal(size=12) / 50], i // 8 % 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    vectors, dims = hard_negatives.whole_vectors(df)
    placed, index = hard_negatives.build(vectors, dims)
    found = placed.collect()
    v, cell = np.array([r["v"] for r in found]), np.array([r["cell"] for r in found])
    first, second = index.bounds(v[:20])
    top = first[:, cell // len(index.books[1])] + second[:, cell % len(index.books[1])]
    assert (hard_negatives.scores(v[:20], v) <= top).all()
    asks = spark.createDataFrame([(100, 1, True, 3, [-(1 << 62)], [1 << 62], found[0]["v"])], hard_negatives.ASK)
    near = hard_negatives.search(placed, index, asks, dims).collect()
    brute = sorted((-int(np.dot(np.array(found[0]["v"]), r["v"])), r["vec_id"]) for r in found if r["label"] == 1 and r["vec_id"] != 100)[:3]
    assert sorted((-r["score"], r["vec_id"]) for r in near) == brute
    plan = asks.selectExpr("query", "label", "same", "k", f"array({-brute[-1][0]}L) low", "high", "v").mapInArrow(hard_negatives.plan_visits(index, dims, True), f"block long, cells array<long>, {hard_negatives.ASK}")
    visited = sum(len(r["cells"]) for r in plan.collect())
    assert visited < (index.rows > 0).sum() / 2


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for most in (100, 1 << 27, 1 << 30):
        a, b = rng.integers(-most, most, (5, 4)), rng.integers(-most, most, (6, 4))
        assert hard_negatives.scores(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]


def brute_codes(rows, parts, entries, rounds=2):
    dims = len(rows[0][1])
    width = dims // parts
    seeds = {}
    for i, v, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        seeds.setdefault(i, v)
    seeds = [seeds[i] for i in sorted(seeds)[:entries]]
    books = [[list(v[p * width : (p + 1) * width]) for v in seeds] for p in range(parts)]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in rows:
                held[near(v, p)[1]].append(cut(v, p))
            new.append([[sum(c) // len(c) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])])
        books = new
    coded, by_label = [], defaultdict(int)
    for i, v, label in rows:
        best = [near(v, p) for p in range(parts)]
        coded.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        by_label[label] += coded[-1][2]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, code, error, by_label[label], sha) for i, code, error, label in coded), key=str)


@pytest.mark.parametrize("dims, parts, entries, leaves, broadcast", [(16, 4, 64, 1 << 13, 100), (12, 3, 5, 3, 0), (8, 8, 256, 2, 100), (6, 1, 64, 1, 100)])
def test_vector_codes(spark, monkeypatch, dims, parts, entries, leaves, broadcast):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", broadcast)
    monkeypatch.setattr(vector_codes.nearest, "__defaults__", (leaves,))
    monkeypatch.setattr(vector_codes, "BATCH_COMPONENTS", 40 * dims)
    rows, df = odd_vectors(spark, dims)
    got = vector_codes.compress(df, parts, entries)
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(whole(rows, dims), parts, entries)


def test_vector_codes_of_nothing(spark):
    _, df = odd_vectors(spark, 4)
    assert vector_codes.compress(df.filter("false")).collect() == []
    without = vector_codes.compress(df.filter("vec_id is null"), 2).collect()
    assert [(r["vec_id"], r["code"], r["error"]) for r in without] == [(None, None, None)]
    with pytest.raises(ValueError):
        vector_codes.compress(df, 3)
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30, 0.0], 1)], "vec_id long, embedding array<double>, label int"), 2).collect()


def test_vector_codes_decode(spark):
    rows, df = odd_vectors(spark, 8)
    kept, dims = vector_codes.whole_vectors(df)
    books = vector_codes.codebooks(kept, 4, 16)
    coded = vector_codes.decode(vector_codes.encode(kept, books), books).withColumnRenamed("v", "near").collect()
    exact = defaultdict(set)
    for i, v, _ in whole(rows, 8):
        exact[i].add(v)
    for r in coded:
        assert r["error"] in {sum((a - b) ** 2 for a, b in zip(v, r["near"])) for v in exact[r["vec_id"]]}


def test_trie_equals_all_distances():
    rng = np.random.default_rng(7)
    for leaves in (1, 2, 7, 50, 1 << 20):
        rows, _ = vector_codes.distinct_parts(rng.integers(-3, 3, (rng.integers(1, 400), 4)))
        book = rng.integers(-4, 4, (9, 4))
        far = ((rows[:, None] - book[None]) ** 2).sum(2)
        entry, error = vector_codes.nearest(rows, book, leaves)
        assert entry.tolist() == far.argmin(1).tolist() and error.tolist() == far.min(1).tolist()


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_vector_codes"])
def test_vector_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, DATA).select(*columns).collect())) == sorted(want.fetchall())
