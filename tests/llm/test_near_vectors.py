import numpy as np
import pyarrow.parquet as pq

from lintlake.llm import near_vectors
from lintlake.llm.components import connected_components


def components(n, edges):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(i) for i in range(n)]


def brute(ids, x, cosine=0.95):
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = n @ n.T >= cosine
    np.fill_diagonal(links, False)
    order = np.argsort(ids)
    part = components(len(ids), [(int(np.flatnonzero(order == a)[0]), int(np.flatnonzero(order == b)[0])) for a, b in np.argwhere(links)])
    return links.sum(1), np.array([ids[order[part[int(np.flatnonzero(order == i)[0])]]] for i in range(len(ids))])


def test_components(spark):
    edges = [(int(a), int(b)) for a, b in np.random.default_rng(3).integers(0, 90, (60, 2))]
    want = components(90, edges)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: want[i] for a, b in edges if a != b for i in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_of_components(spark):
    got = connected_components(spark.range(40).selectExpr("id as a", "id + 1 as b")).collect()
    assert len(got) == 41 and {r["component"] for r in got} == {0}


def test_table_equals_brute_force(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    links, part = brute(np.array(t["vec_id"]), np.array(t["embedding"], float))
    got = {r["vec_id"]: r for r in near_vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).collect()}
    assert len(got) == len(links)
    assert all((got[v]["n_links"], got[v]["component_id"], got[v]["kept"]) == (n, p, v == p) for v, n, p in zip(t["vec_id"], links.tolist(), part.tolist()))


def test_recall_on_scattered_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 24))
    near = np.repeat(base[:400], 2, axis=0)
    near += rng.normal(size=near.shape) * 0.28 * np.linalg.norm(near, axis=1, keepdims=True) / np.sqrt(24)
    x = np.concatenate([base, near, base[:60], base[:1] * 3])
    monkeypatch.setattr(near_vectors, "TILE_MEMBERS", 64)
    monkeypatch.setattr(near_vectors, "TILE_QUERIES", 200)
    monkeypatch.setattr(near_vectors, "LIST_ROWS", 60)
    ids = np.arange(len(x)) * 3
    links, _ = brute(ids, x)
    frame = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, rep string")
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_duplicates(frame).collect()}
    mine = np.array([got[int(i)] for i in ids])
    assert (mine <= links).all() and mine.sum() >= 0.9 * links.sum() > 900


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in near_vectors.near_duplicates(frame).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (None, 3, 1, False)] + [(i, 0, i, True) for i in range(4, 11)]
    assert got == sorted(want, key=str)
    assert near_vectors.near_duplicates(frame.limit(0)).count() == 0


def test_rows_without_an_id_link(spark):
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.001]), (None, [0.0, 1.0]), (None, [0.001, 1.0]), (None, None), (None, [0.0, 0.0])]
    got = sorted((tuple(r) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (None, 1, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (None, 0, None, True)], key=str)


def test_one_id_with_other_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]
    got = sorted(tuple(r) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_magnitudes_and_lengths(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1.01e-200]), (3, [1e200, -1e200]), (4, [5e-324, 5e-324])]
    rows += [(10, [1.0, 0.0, 0.0]), (11, [2.0, 0.1, 0.0]), (12, [0.0, 0.0, 1.0]), (13, [1.0]), (14, [2.0]), (15, [-1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1), 10: (1, 10), 11: (1, 10), 12: (0, 12), 13: (1, 13), 14: (1, 13), 15: (0, 15)}


def test_recall_with_production_parameters(spark):
    """Planted partners at cosines of 0.95 to 0.97, the hardest that count, against brute force."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(9_000, 64))
    source = base[:600] / np.linalg.norm(base[:600], axis=1, keepdims=True)
    away = rng.normal(size=source.shape)
    away -= (away * source).sum(1, keepdims=True) * source
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = rng.uniform(0.95, 0.97, (600, 1))
    x = np.vstack([base, source * cos + away * np.sqrt(1 - cos**2)])
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int((n @ n.T >= 0.95).sum()) - len(x)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert 0.9 * want <= sum(r["n_links"] for r in near_vectors.near_duplicates(frame).collect()) <= want and want >= 1_200


def test_recall_with_thousands_of_lists():
    """As many lists as a table of 17 million vectors has: a partner's list is probed from one side at least."""
    rng = np.random.default_rng(12)
    base = near_vectors.unit(rng.normal(size=(21_000, 64)))
    source, away = base[:1_000], rng.normal(size=(1_000, 64))
    away -= (away * source).sum(1, keepdims=True) * source
    near = source * 0.95 + near_vectors.unit(away) * np.sqrt(1 - 0.95**2)
    index = near_vectors.VectorIndex.fit(base[-20_000:], 65_536 * near_vectors.LIST_ROWS)
    assert len(index.halves[0]) * len(index.halves[1]) == 65_536
    a, b = index.probes(source), index.probes(near)
    assert ((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean() >= 0.9
