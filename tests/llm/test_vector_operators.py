"""Ball k-means and heap Lloyd against plain rounds over Python's integers, and their queries against their SQL."""

import hashlib
import math
import pathlib
import random

import duckdb
import numpy as np
import pytest

from skyloom.llm import ball_kmeans, heap_lloyd, oracles, registry, vector_blocks

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, raw binary"


def exact(x, scale):
    return math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale


def squared(a, b):
    return sum((u - v) ** 2 for u, v in zip(a, b))


def kept(rows, dim, scale):
    return [(i, [exact(x, scale) for x in np.array(v, np.float32).tolist()], label) for i, v, label in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]


def lloyd(vectors, centres, rounds):
    labels = []
    for last in (*[False] * rounds, True):
        labels = [min(range(len(centres)), key=lambda j: (squared(v, centres[j]), j)) for v in vectors]
        if last:
            return labels, centres
        groups = [[v for v, k in zip(vectors, labels) if k == j] for j in range(len(centres))]
        centres = [[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(groups, centres)]


def digest(vectors):
    return hashlib.sha256(",".join(str(c) for v in vectors for c in v).encode()).hexdigest()


def fits(v):
    return v if v < 2**63 else None


def brute_kmeans(rows, k, rounds, seed, scale, dim):
    vs = kept(rows, dim, scale)
    order = sorted(vs, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    if not vs:
        return []
    labels, centres = lloyd([v for _, v, _ in vs], [v for _, v, _ in order[:k]], rounds)
    d = [squared(v, centres[j]) for (_, v, _), j in zip(vs, labels)]
    lost = any(x >= 2**63 for x in d)
    own = [sum(x for x, k in zip(d, labels) if k == j) if all(x < 2**63 for x, k in zip(d, labels) if k == j) else 2**64 for j in range(len(centres))]
    return sorted(((i, j, fits(x), fits(own[j]), None if lost else fits(sum(d)), digest([centres[j]])) for (i, _, _), j, x in zip(vs, labels, d)), key=str)


def brute_codes(rows, parts, entries, rounds, scale, dim):
    vs = sorted(kept(rows, dim, scale), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not vs:
        return []
    w, codes, errors, books = dim // parts, [""] * len(vs), [0] * len(vs), []
    for p in range(parts):
        xs = [v[p * w : (p + 1) * w] for _, v, _ in vs]
        labels, centres = lloyd(xs, xs[:entries], rounds)
        books += centres
        for i, j in enumerate(labels):
            codes[i] += f"{j:02x}"
            errors[i] += squared(xs[i], centres[j])
    by = {}
    for (_, _, label), e in zip(vs, errors):
        by.setdefault(label, []).append(e)
    by = {label: fits(sum(es)) if max(es) < 2**63 else None for label, es in by.items()}
    return sorted(((i, c, fits(e), by[label], digest(books)) for (i, _, label), c, e in zip(vs, codes, errors)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", b"y") for i, v, label in rows], SCHEMA).repartition(3)


def vectors(seed, n, dim, spread, ids=None):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    return [(i if ids is None else ids(i), [c + r.gauss(0, spread) for c in r.choice(middles)], r.choice([0, 1, None])) for i in range(n)]


def ties(seed, n, dim):
    """Small integers, so that many distances and vectors are equal."""
    r = random.Random(seed)
    return [(i, [float(r.randint(-1, 1)) for _ in range(dim)], i % 3) for i in range(n)]


def odd(dim):
    good = vectors(7, 30, dim, 0.1)
    v = good[0][1]
    return [
        *good, *good[:4], *[(500, v, 9)] * 5, (None, v, 1), (None, [0.5] * dim, None), (31, None, 1), (32, [], 1), (33, v[1:], 1), (34, [None, *v[1:]], 1), (35, [math.nan, *v[1:]], 1), (36, [math.inf, *v[1:]], 1), (37, [-math.inf, *v[1:]], 1)
    ]


def huge(dim):
    return [*vectors(8, 25, dim, 0.1), (90, [3e38] * dim, 1), (91, [-3e38, *[1e30] * (dim - 1)], 1), (92, [1e12] * dim, 2), (93, [-2.5e8] * dim, 2)]


CASES = [vectors(1, 300, 4, 0.05), vectors(2, 200, 4, 0.6), ties(3, 200, 4), odd(4), huge(4), vectors(4, 3, 4, 0.3), []]


@pytest.mark.parametrize("rows", CASES, ids=["balls", "spread", "ties", "odd", "huge", "few", "none"])
def test_ball_kmeans_equals_plain_rounds(spark, rows):
    got = ball_kmeans.ball_kmeans(frame(spark, rows), 5, 6, 3, 1024, 4, block_rows=64)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_kmeans(rows, 5, 6, 3, 1024, 4)


@pytest.mark.parametrize("rows", CASES, ids=["balls", "spread", "ties", "odd", "huge", "few", "none"])
def test_heap_codes_equal_plain_rounds(spark, rows):
    got = heap_lloyd.heap_codes(frame(spark, rows), 2, 6, 5, 4096, 4, block_rows=64)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows, 2, 6, 5, 4096, 4)


def test_balls_and_heaps_spare_comparisons(monkeypatch):
    """Separated clusters: stable cores and parts above their drift are not compared again."""
    x = vector_blocks.quantised(np.array([v for _, v, _ in vectors(1, 400, 4, 0.02)]), 1024)
    asked = []
    plain = vector_blocks.squared
    for module in (ball_kmeans, heap_lloyd):
        monkeypatch.setattr(module, "squared", lambda a, b, most=None: asked.append(len(a) * len(b)) or plain(a, b, most))
    centres = [x[i].tolist() for i in range(8)]
    labels, d = ball_kmeans.nearest(x, np.array(centres))
    radii = [math.sqrt(d[labels == j].max()) if (labels == j).any() else 0.0 for j in range(8)]
    found = ball_kmeans.balls(centres, radii, 4)
    asked.clear()
    again, _ = ball_kmeans.reassigned(x, labels, found)
    assert (again == labels).all() and sum(asked) < 0.6 * 8 * len(x)
    block = vector_blocks.Block([], x, b"", None)
    books = heap_lloyd.Books([np.array(centres)], np.zeros((1, 8)))
    block.memory, _ = heap_lloyd.visited(block, None, books)
    asked.clear()
    heap_lloyd.visited(block, None, heap_lloyd.Books(books.entries, np.full((1, 8), 2.0)))
    assert sum(asked) < 0.6 * 8 * len(x)


def test_heaps_pop_and_push():
    r = np.random.default_rng(1)
    labels, keys = r.integers(0, 3, 50), r.random(50).astype(np.float32)
    heaps = heap_lloyd.Heaps.of(4, labels, keys, np.arange(50))
    entry, parts = heaps.pop(np.array([0.5, 0.1, 0.0, 1.0]))
    assert sorted(parts.tolist()) == sorted(np.flatnonzero(keys <= np.array([0.5, 0.1, 0.0])[labels]).tolist()) and (labels[parts] == entry).all()
    moved = (labels[parts] + 1) % 4
    heaps.push(moved, r.random(len(parts)).astype(np.float32), parts)
    labels[parts] = moved
    again = heap_lloyd.Heaps.load(heaps.dump(), 4, 50)
    assert (again.labels() == labels).all()
    assert all((np.diff(again.keys[a:b]) >= 0).all() for a, b in zip(again.starts[:-1], again.starts[1:]))


@pytest.mark.parametrize("name", ["op11_ball_kmeans", "op12_heap_lloyd"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    df = registry.queries()[name](spark, sf)
    rows = df.collect()
    assert len(rows) == con.sql("SELECT count(*) FROM embeddings").fetchall()[0][0]
    assert sorted(map(tuple, rows)) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_scratch_tables_are_deleted(spark):
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "skyloom")
    names = lambda: {p.name for p in folder.iterdir()} if folder.exists() else set()
    before = names()
    heap_lloyd.heap_codes(frame(spark, vectors(1, 50, 4, 0.1)), 2, 4, 3, 4096, 4)
    ball_kmeans.ball_kmeans(frame(spark, vectors(1, 50, 4, 0.1)), 4, 3, 3, 1024, 4)
    assert sorted(n.rsplit("-", 1)[0] for n in names() - before) == ["ball-result", "heap-result"]
