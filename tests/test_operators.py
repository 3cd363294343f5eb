"""Operators on the seven-point line and other small fixtures with known values."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktraj.functions.quantiles import exact_quantiles
from sparktraj.operators import cluster, complexes, homology, knn, points, solve, sparse, walks
from sparktraj.operators.components import connected
from sparktraj.sources import fcs, io

LINE = [0.0, 1.0, 3.0, 6.0, 10.0, 15.0, 21.0]


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame([(i, [v]) for i, v in enumerate(LINE)], "id long, x array<double>")


@pytest.fixture(scope="module")
def lists(line):
    return knn.knn(line, 2).cache()


def edges(df):
    return {(r["src"], r["dst"]): r["w"] for r in df.collect()}


def test_neighbours(lists):
    got = {}
    for r in lists.orderBy("src", "rnk").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    assert got == {0: [1, 2], 1: [0, 2], 2: [1, 0], 3: [2, 4], 4: [3, 5], 5: [4, 6], 6: [5, 4]}


def test_similarity(lists):
    s = edges(sparse.symmetrize(sparse.kernel(sparse.distances(lists))))
    want = {(0, 1): 0.778801, (0, 2): 0.236928, (1, 2): 0.527292, (2, 3): 0.479652, (3, 4): 0.453789, (4, 5): 0.437602, (4, 6): 0.187357, (5, 6): 0.607581}
    assert {k: round(v, 6) for k, v in s.items() if k[0] < k[1]} == want
    assert all(s[a, b] == s[b, a] for a, b in s)


@pytest.mark.parametrize("method,exact", [("cg", 1000), ("cg", 1), ("minres", 1), ("bicgstab", 1)])
def test_hitting_time(lists, method, exact):
    k = sparse.symmetrize(sparse.kernel(sparse.distances(lists)))
    got = {r["id"]: r["pt"] for r in solve.hitting(k, 0, None, method, exact).collect()}
    assert np.allclose([got[i] for i in range(7)], [0, 5.117751, 10.19959, 18.231051, 24.663267, 27.50893, 27.838243], atol=1e-5)


def test_hitting_distance_and_distributed_solver(lists):
    k = sparse.symmetrize(sparse.kernel(sparse.distances(lists))).cache()
    d = sparse.symmetrize(sparse.distances(lists)).cache()
    want = [0, 19.565254, 44.985778, 88.471664, 127.265026, 144.818334, 147.859677]
    got = {r["id"]: r["pt"] for r in solve.hitting(k, 0, d).collect()}
    assert np.allclose([got[i] for i in range(7)], want, atol=1e-4)
    for exact in (1000, 1):
        got = {r["id"]: r["pt"] for r in solve.hitting(k, 0, d, exact=exact, local_edges=1).collect()}
        assert np.allclose([got[i] for i in range(7)], want, atol=1e-4)


@pytest.mark.parametrize("method", ["cg", "minres", "bicgstab"])
def test_large_graphs_keep_all_arguments(spark, method):
    """The distributed way, forced by a small limit, agrees with the one in memory: targets, an unreachable part, and for bicgstab a
    system that isn't symmetric."""
    rng = np.random.default_rng(2)
    rows = [(a, b, float(rng.uniform(0.5, 2))) for a in range(12) for b in range(12) if a < b and (b - a < 3)] + [(20, 21, 1.0)]
    rows += [(b, a, w * (2.0 if method == "bicgstab" else 1.0)) for a, b, w in rows]
    k = spark.createDataFrame(rows, "src long, dst long, w double")
    want = {r["id"]: r["pt"] for r in solve.hitting(k, 0, None, method, 1, targets={7: 3.0}).collect()}
    got = {r["id"]: r["pt"] for r in solve.hitting(k, 0, None, method, 1, targets={7: 3.0}, local_edges=1).collect()}
    assert want[20] is None and want[7] == 3.0 and want.keys() == got.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-7) if want[i] is not None else got[i] is None for i in want)


def test_labels_of_large_graphs(spark, lists):
    k = sparse.symmetrize(sparse.kernel(sparse.distances(lists))).cache()
    seeds = spark.createDataFrame([(0, "a"), (6, "b")], "id long, label string")
    want = {(r["id"], r["label"]): r["score"] for r in solve.label_scores(k, seeds).collect()}
    got = {(r["id"], r["label"]): r["score"] for r in solve.label_scores(k, seeds, exact=1, local_edges=1).collect()}
    assert want.keys() == got.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)
    assert {r["id"]: r["label"] for r in solve.propagate_labels(k, seeds).collect()} == {0: "a", 1: "a", 2: "a", 3: "b", 4: "b", 5: "b", 6: "b"} or want[3, "a"] > 0.5


def test_eigenvectors_in_memory_and_as_tables(spark, monkeypatch):
    rng = np.random.default_rng(3)
    u = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    lam = np.array([1.0, 0.9, 0.8])
    a = u[:, :3] * lam @ u[:, :3].T
    e = spark.createDataFrame([(p, q, float(a[p, q])) for p in range(20) for q in range(20)], "src long, dst long, w double").cache()
    monkeypatch.setattr(sparse, "DENSE_ROWS", 1)
    _, got, v = sparse.leading_eigenvectors(e, 3)
    assert np.allclose(got, lam, atol=1e-7) and np.abs(a @ v - v * got).max() < 1e-7
    got, t = sparse.table_eigenvectors(e, 3)
    v = np.array([r["x"] for r in t.orderBy("id").collect()])
    assert np.allclose(got, lam, atol=1e-7) and np.abs(a @ v - v * got).max() < 1e-5


def test_kernels_of_rows(spark):
    n = spark.createDataFrame([(0, 1, 1, 1.0), (0, 2, 2, 2.0), (0, 3, 3, 4.0)], "src long, dst long, rnk int, dist double")
    got = edges(sparse.kernel(sparse.distances(n), "semr"))  # d^2 over the largest d
    assert np.allclose([got[0, i] for i in (1, 2, 3)], np.exp([-1 / 4, -4 / 4, -16 / 4]))
    got = edges(sparse.kernel(sparse.distances(n), "expsigma"))
    assert sum(got.values()) == pytest.approx(math.log2(3), abs=1e-4)
    assert math.log(got[0, 3]) == pytest.approx(4 * math.log(got[0, 1]))


def test_transition_of_symmetrised_distances(spark):
    n = spark.createDataFrame([(0, 1, 1, 1.0), (1, 0, 1, 1.0), (2, 1, 1, 3.0)], "src long, dst long, rnk int, dist double")
    got = edges(sparse.transition_matrix(n, sym="min", normalize=False))
    # rows of the symmetrised distances: 0: {1: 1}, 1: {0: 1, 2: 3} with median 2, 2: {1: 3}
    assert np.allclose([got[0, 1], got[1, 0], got[1, 2], got[2, 1]], np.exp([-1, -1 / 4, -9 / 4, -1]))


def test_scales_of_flow(spark):
    from sparktraj.operators import flow

    c = spark.createDataFrame([(1, 2, 8), (2, 1, 2), (2, 3, 5), (3, 2, 1)], "a long, b long, n long")
    # ins 2 9 5, outs 8 7 1; ratios 4, 7/9, 1/5
    o = spark.createDataFrame([(1,)], "mc long")
    w = {k: {(r["a"], r["b"]): r["weight"] for r in flow.flow_edges(c, k, origins=o).collect()} for k in ("max", "adaptive", "mean")}
    assert w["max"] == {(1, 2): 8 / 8, (2, 3): 5 / 8}
    assert w["adaptive"] == {(1, 2): 8 / 8, (2, 3): 5 / 9}
    assert w["mean"] == {(1, 2): 8 / 5, (2, 3): 5 / 8}


def test_density_boundary(spark):
    n = spark.createDataFrame([(i, 100 + r, r, float(d)) for i, d in enumerate([1, 2, 4, 5]) for r in (1, 2)], "src long, dst long, rnk int, dist double")
    dens = {r["id"]: r["dens"] for r in points.densities(n, 3, 1.0).collect()}  # 3 / (4 * 2) / dist
    assert np.allclose([dens[i] for i in range(4)], [0.375, 0.1875, 0.09375, 0.075])
    asc = np.sort(list(dens.values()))
    cdf = np.cumsum((1 / asc)[::-1])[::-1]
    bound = 3 / cdf[0]
    if bound > asc[0]:
        target = (3 - np.arange(1, 5)) / cdf
        bound = target[np.argmax(target <= asc)]
    u = {r["id"]: r["u"] for r in n.select(F.col("src").alias("id")).distinct().select("id", points.uniform(7, "id").alias("u")).collect()}
    assert {r["id"] for r in points.down_sample(n, 3, 3, 1.0).collect()} == {i for i in dens if bound / dens[i] > u[i]}


def test_neighbourhood_of_positions(spark):
    w = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 30)], "walk_id long, step int, v long")
    e = spark.createDataFrame([(10, 20, 2.0), (20, 30, 6.0), (20, 1, 4.0), (20, 2, 4.1), (10, 3, 2.0), (10, 4, 2.5), (30, 5, 6.0), (30, 6, 7.0)], "src long, dst long, w double")
    # thresholds: 2 at the first, (2 + 6) / 2 in the middle, 6 at the last
    assert sorted(r["id"] for r in walks.neighbourhood(w, e).collect()) == [1, 3, 5, 10, 20, 30]


def test_path_distances(spark):
    g = spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 1, [1.0, 1.0]), (2, 0, [3.0, -1.0]), (2, 1, [1.0, 3.0])], "walk_id long, g int, x array<double>")
    want = {"max": 3 + 0.5 * 2, "sum": 6 + 0.5 * 2, "euclid": math.sqrt(14) + 0.5 * 2, "abs_sum": 4 + 0.5 * 2}
    assert {m: walks.path_distances(g, m, 0.5).first()["dist"] for m in want} == pytest.approx(want)
    assert walks.path_distances(g.limit(0)).count() == 0


def test_handle(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (5, [4.0, 2.0])], "id long, x array<double>")
    got = [r["x"] for r in io.handle(p, 1, 5, 0.5).orderBy("id").collect()]
    assert got == [[0, 0, 0], [4, 2, 0], [0, 0, 5], [0, 0, 10], [4, 2, 5], [4, 2, 10], [2, 1, 10], [4, 2, 10]]


def test_tunnelling_walks_keep_to_the_rule(spark):
    """Against the rule step by step, with the same uniforms."""
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 0, 0.5), (0, 3, 0.2)], "src long, dst long, w double")
    t, beta = {0: 0.0, 1: 1.0, 2: 2.0, 3: 9.0}, [1.0, 0.5, 0.0, 2.0, 1.0, 0.1, 3.0]
    got = {}
    for r in walks.tunnelling(e, spark.createDataFrame(list(t.items()), "id long, pt double"), 0, 40, beta, 0.7, every=3).orderBy("walk_id", "step").collect():
        got.setdefault(r["walk_id"], []).append(r["v"])
    us = {(r["w"], r["i"]): (r["a"], r["b"]) for r in spark.sql("select w, i from range(1, 41) t(w), range(1, 8) s(i)").select("w", "i", points.uniform(1, "w", "i").alias("a"), points.uniform(2, "w", "i").alias("b")).collect()}
    out = {0: [(1, 1 / 1.2), (3, 1.0)], 1: [(0, 0.5), (2, 1.0)], 2: [(0, 0.5 / 1.5), (1, 1.0)]}
    for w in range(1, 41):
        v, m, path = 0, 0.0, [0]
        for i, b in enumerate(beta, 1):
            if v not in out:
                break
            a, c = us[w, i]
            y = next(d for d, hi in out[v] if a < hi)
            m = max(m, t[y])
            lost = lambda z: 1 - math.exp(-0.7 * (m - t[z]))  # noqa: B023, E731
            if t[y] >= t[v] or (b and math.exp(-(lost(y) - lost(v)) / b) > c):
                v = y
                path.append(v)
        assert got[w] == path


def test_kmer_nodes_in_order(spark):
    rng = np.random.default_rng(4)
    seqs = [[int(v) for v in rng.integers(0, 9, 12)] for _ in range(6)]
    w = spark.createDataFrame([(i, s + 1, v) for i, q in enumerate(seqs) for s, v in enumerate(q)], "walk_id long, step int, v long")
    near = {v: {(v + 1) % 9} for v in range(9)}
    km = walks.kmers(w, 3)
    rows = [tuple(r["kmer"]) for r in km.orderBy("walk_id", "step").collect()]
    reach = lambda k: set(k) | {u for v in k for u in near[v]}
    like = lambda a, b: a == b or len(set(a) & reach(b)) == len(a) or len(set(b) & reach(a)) == len(b)
    kept = []
    for k in rows:
        if not any(like(k, n) for n in kept):
            kept.append(k)
    e = spark.createDataFrame([(v, u, 1.0) for v in near for u in near[v]], "src long, dst long, w double")
    assert {tuple(r["kmer"]) for r in walks.kmer_nodes(km, e).collect()} == set(kept)
    g = walks.kmer_graph(km, e)
    assert {tuple(r["src"]) for r in g.collect()} <= set(kept) and g.count() > 0


def test_splines_keep_cubics(spark):
    at = np.arange(6.0)
    y = np.stack([at**3 - 2 * at, 1 - at**2], 1)
    w = spark.createDataFrame([(1, i + 1, v.tolist()) for i, v in enumerate(y)] + [(2, i + 1, v.tolist()) for i, v in enumerate(y + 2)], "walk_id long, step int, x array<double>")
    got = np.array([r["x"] for r in walks.smooth(w.where("walk_id = 1"), 2).orderBy("step").collect()])
    fine = np.linspace(0, 5, 18)
    assert np.allclose(got, np.stack([fine**3 - 2 * fine, 1 - fine**2], 1))
    c = walks.consensus(w, spark.createDataFrame([(1, 7), (2, 7)], "walk_id long, class long"), 2).orderBy("step").collect()
    assert len(c) == 18 and np.allclose([r["x"] for r in c], got + 1)


def test_places_of_essential_classes(spark):
    f = spark.createDataFrame([(1, 1, 5, 1.0, 2.0), (1, 2, 6, 2.0, 3.0)], "dim int, birth_idx int, death_idx int, birth double, death double")
    e = spark.createDataFrame([(1, 7, 1.5), (1, 8, 1.0)], "dim int, sidx int, birth double")
    got = {r["birth_idx"]: (r["birth"], r["death"]) for r in homology.with_essential(f, e).where("death_idx is null").collect()}
    m, low = 1.01 * 3, 1.01 * 2
    assert got[8] == pytest.approx((m / 3, m)) and got[7] == pytest.approx(((m + (m - low) / 2) / 3, m + (m - low) / 2))
    assert homology.with_essential(f.limit(0), e.limit(1)).first()["death"] == pytest.approx(1.01)


def test_essential_classes_are_named_in_order_of_walks(spark):
    """Against one walk after the other, for cycles over columns that leave two classes open."""
    rng = np.random.default_rng(5)
    red = spark.createDataFrame([(20, 5, 1, [1, 5]), (21, 7, 1, [2, 3, 7])], "col int, low int, dim int, entries array<int>")
    sets = {w: sorted({int(v) for v in rng.integers(1, 10, 5)}) for w in range(1, 40)}
    c = spark.createDataFrame([(w, e) for w, s in sets.items() for e in s], "walk_id long, e int")
    one = homology.Representation(red.toPandas())
    want = {w: one.of(set(s)) for w, s in sets.items()}
    assert {r["walk_id"]: r["classes"] for r in homology.represent(c, red).collect()} == want


def test_ranks_of_a_complex(spark):
    """Betti numbers of a random complex by ranks modulo 2 of its boundary matrices."""
    rng = np.random.default_rng(6)
    m = spark.createDataFrame([(i, rng.uniform(size=2).tolist()) for i in range(14)], "id long, x array<double>")
    d = knn.knn(m, 13).select("src", "dst", F.col("dist").alias("w"))
    f = complexes.index(complexes.rips(d, 0.42)).cache()
    red = homology.reduce_boundary(complexes.boundary(f)).cache()
    rows = {tuple(r["verts"]): r["sidx"] for r in f.collect()}

    def rank(dim):
        cols = [s for s in rows if len(s) == dim + 2]
        at = {s: i for i, s in enumerate(x for x in rows if len(x) == dim + 1)}
        a = np.zeros((len(at), len(cols)), bool)
        for j, s in enumerate(cols):
            for v in s:
                a[at[tuple(u for u in s if u != v)], j] = True
        r = 0
        for j in range(a.shape[1]):
            p = np.nonzero(a[r:, j])[0]
            if len(p):
                a[[r, r + p[0]]] = a[[r + p[0], r]]
                hit = np.nonzero(a[:, j])[0]
                a[hit[hit != r]] ^= a[r]
                r += 1
        return r

    n = {r["dim"]: r["count"] for r in red.groupBy("dim").count().collect()}
    assert n.get(0, 0) == rank(0) and n.get(1, 0) == rank(1) > 0


def test_chains_that_are_cycles(spark):
    b = spark.createDataFrame([(3, 1, [0, 1]), (4, 1, [1, 2]), (5, 1, [0, 2])], "sidx int, dim int, faces array<int>")
    c = spark.createDataFrame([("a", 3), ("a", 4), ("a", 5), ("b", 3), ("b", 4)], "k string, e int")
    assert {r["k"]: r["cycle"] for r in homology.is_cycle(c, b, ["k"]).collect()} == {"a": True, "b": False}


def test_gamma_variates_have_their_moments():
    ids = np.arange(200_000)
    g = points.gamma_of(ids, 1, ids % 7, 0.1, 5)
    assert g.mean() == pytest.approx(0.1, rel=0.03) and g.var() == pytest.approx(0.1, rel=0.06)
    assert (points.gamma_of(ids[:50], 1, ids[:50] % 7, 0.1, 5) == g[:50]).all()


def test_medoids_and_labels_for_sampling(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=2) * 0.1 + [10 * (i % 3), 0]).tolist()) for i in range(90)]
    p = spark.createDataFrame(rows, "id long, x array<double>")
    for method in ("CLARA", "kmeans"):
        got = {r["id"]: r["label"] for r in cluster.cluster_labels(p, 3, method).collect()}
        assert len(set(got.values())) == 3 and all(got[i] == got[i % 3] for i in range(90))


def test_directed_graph_leads_away_from_the_origin(lists):
    got = edges(solve.directed_graph(lists, 0))
    assert all(a < b for a, b in got) and len(got) == 8
    assert len(edges(solve.directed_graph(lists, 0, directed=False))) == 16


def test_tracked_channels(spark):
    from sparktraj.operators import track

    w = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "walk_id long, step int, v long")
    seg = spark.createDataFrame([(5, 1), (6, 1)], "id long, segment int")
    p = spark.createDataFrame([(5, [1.0, 2.0, 3.0]), (6, [3.0, 4.0, 9.0])], "id long, x array<double>")
    assert track.tracked(w, seg, p, [2]).first()["value"] == 6.0
    assert {r["marker"]: r["value"] for r in track.tracked(w, seg, p, [0, 2]).collect()} == {0: 2.0, 2: 6.0}


def test_clusters_need_a_shared_folder(monkeypatch):
    from sparktraj.sources import shared

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://a:7077"}.get(key, default)

    with pytest.raises(ValueError):
        shared.shared_dir(type("S", (), {"conf": Conf()})())


def test_unreachable_vertices_have_no_time(spark):
    k = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "src long, dst long, w double")
    got = {r["id"]: r["pt"] for r in solve.hitting(k, 0).collect()}
    assert got[0] == 0 and got[1] == pytest.approx(1) and got[2] is None and got[3] is None


def test_orientation(spark, lists):
    k = sparse.symmetrize(sparse.kernel(sparse.distances(lists)))
    pt = spark.createDataFrame(list(enumerate([0.0, 5.117751, 10.19959, 18.231051, 24.663267, 27.50893, 27.838243])), "id long, pt double")
    assert [r["bin"] for r in sparse.rank_bins(pt, 3).orderBy("id").collect()] == [1, 1, 1, 2, 2, 3, 3]
    o = {k: round(v, 6) for k, v in edges(sparse.orient(k, pt, 3, 1.5)).items()}
    assert o == {(0, 1): 0.766741, (0, 2): 0.233259, (1, 2): 1, (2, 3): 1, (3, 4): 1, (4, 5): 0.700209, (4, 6): 0.299791, (5, 6): 1}
    t = sparse.orient(k, pt, 3, 1.5).cache()
    assert [r["id"] for r in walks.fates(t).collect()] == [6]
    steps, stats = walks.simulate(t, 0, 20)
    assert {r["v"] for r in walks.termini(steps).collect()} == {6} and stats.count() == 20
    assert walks.ancestors(t, spark.createDataFrame([(3,)], "id long")).count() == 4
    to, _ = walks.walks_to(t, 0, spark.createDataFrame([(5,), (3,), (99,)], "id long"), 10)
    assert {(r["fate"], r["v"]) for r in to.groupBy("fate", "walk_id").agg(F.max_by("v", "step").alias("v")).collect()} == {(5, 5), (3, 3)}
    assert to.select("walk_id").distinct().count() == 20 and to.agg(F.max("walk_id")).first()[0] == 20


@pytest.mark.parametrize("walk,want", [([1, 1], [1, 1]), ([1, 1, 1], [1]), ([1, 2, 1], [1]), ([1, 2, 3, 2, 4], [1, 2, 4]), ([5], [5])])
def test_remove_cycles(spark, walk, want):
    w = spark.createDataFrame([(7, i + 1, v) for i, v in enumerate(walk)], "walk_id long, step int, v long")
    assert [r["v"] for r in walks.remove_cycles(w).orderBy("step").collect()] == want


def test_contract(spark):
    w = spark.createDataFrame([(1, i + 1, i) for i in range(5)], "walk_id long, step int, v long")
    c = spark.createDataFrame(list(enumerate([10, 10, 20, 20, 10])), "id long, cluster long")
    got = walks.contract(w, c)
    assert [r["v"] for r in got.orderBy("step").collect()] == [10, 20, 10]
    assert [r["v"] for r in walks.remove_cycles(got).collect()] == [10]


def test_circumradius():
    tri = np.array([[[0, 0], [2, 0], [1, math.sqrt(3)]], [[0, 0], [4, 0], [2, 0.5]], [[0, 0], [1, 0], [2, 0]]], float)
    assert np.allclose(complexes.circumradius2(tri)[:2], [4 / 3, 18.0625]) and complexes.circumradius2(tri)[2] == np.inf


def test_homology_of_a_square(spark):
    m = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 1.0])], "id long, x array<double>")
    d = knn.knn(m, 3).select("src", "dst", F.col("dist").alias("w"))
    f = complexes.index(complexes.rips(d, 1.2)).cache()
    red = homology.reduce_boundary(complexes.boundary(f)).cache()
    assert red.where("dim = 0").count() == 3
    assert [r["dim"] for r in homology.essential(red, f).orderBy("dim").collect()] == [0, 1]
    w = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 4), (2, 3, 3)], "walk_id long, step int, v long")
    cycle = homology.cycles_against(homology.triangulate(w, f, m), 1)
    assert cycle.count() == 4
    got = homology.represent(cycle, red).collect()
    assert len(got) == 1 and got[0]["classes"][0] < 0


def test_dendrogram(spark):
    c = spark.createDataFrame([(1, [5]), (2, [5, 7]), (3, []), (4, [])], "walk_id long, classes array<int>")
    got = {r["walk_id"]: r["leaf"] for r in homology.dendrogram(c, {5: 2.0, 7: 1.0}).collect()}
    assert got == {1: "ROOT_5_-7", 2: "ROOT_5_7", 3: "ROOT_-5", 4: "ROOT_-5"}


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_quantiles_with_ties_and_many_rows(spark):
    rng = np.random.default_rng(0)
    a = np.r_[np.round(rng.normal(size=40_000), 3), np.zeros(20_000)]
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", 2.0), ("b", None), (None, 1.0)], "k string, v double")
    got = {(r["k"], r["p"]): r["q"] for r in exact_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.999, 1.0]).collect()}
    for p in (0.0, 0.1, 0.5, 0.999, 1.0):
        assert got["a", p] == pytest.approx(np.quantile(a, p), abs=1e-12)
        assert got["b", p] == 2.0 and got[None, p] == 1.0


def test_louvain_finds_two_cliques(spark):
    e = [(a, b, 1.0) for s in (0, 10) for a in range(s, s + 5) for b in range(s, s + 5) if a != b] + [(0, 10, 0.1), (10, 0, 0.1)]
    got = {r["id"]: r["mc"] for r in cluster.louvain(spark.createDataFrame(e, "src long, dst long, w double")).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]


def test_fcs_round_trip(spark, tmp_path):
    x = np.arange(12, dtype=float).reshape(4, 3) / 8
    fcs.write_file(str(tmp_path / "a.fcs"), x, ["FSC", "SSC", "T|ime"], keywords={"$OP": "me"})
    spark.dataSource.register(fcs.FcsSource)
    got = spark.read.format("fcs").load(str(tmp_path / "*.fcs")).orderBy("event").collect()
    assert [r["x"] for r in got] == x.tolist() and [r["event"] for r in got] == [1, 2, 3, 4]
    assert [c[1] for c in fcs.channels(str(tmp_path / "a.fcs"))] == ["FSC", "SSC", "T|ime"]
    df = spark.createDataFrame([(x[0].tolist(),)], "x array<double>")
    df.write.format("fcs").mode("append").option("names", "a,b,c").save(str(tmp_path / "out"))
    assert spark.read.format("fcs").load(str(tmp_path / "out")).first()["x"] == x[0].tolist()


def test_construct_refuses_bad_clouds(spark):
    bad = spark.createDataFrame([(1, [1.0]), (1, [2.0])], "id long, x array<double>")
    with pytest.raises(ValueError):
        io.construct(bad)


def test_empty_clouds(spark):
    none = spark.createDataFrame([], "id long, x array<double>")
    assert knn.knn(none, 3).count() == 0
    assert points.farthest_points(none, 3).count() == 0
    assert walks.remove_cycles(spark.createDataFrame([], "walk_id long, step int, v long")).count() == 0


def test_session(spark, tmp_path):
    from sparktraj.session import Trajectory

    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * 0.3 + [i / 40, 0, 0]).tolist()) for i in range(200)]
    labels = [(i, "start" if i < 20 else "rest") for i in range(200)]
    t = Trajectory(spark.createDataFrame(rows, "id long, x array<double>"), spark.createDataFrame(labels, "id long, label string"), 3)
    t.set_origin("start").knn(20, "exact").cluster(12).filtration(6).solve_pseudotime(k=10).simulate_walks(15, k=10).dim_red("pca")
    assert t.pseudotime["start"].count() == 200 and t.walk_stats["start"].count() == 15
    nodes, flows = t.connectome()
    assert nodes.count() > 0 and flows.columns
    assert t.classify_walks().columns == ["walk_id", "classes"]
    t.classify_walks().count()
    some = t.walks["start"].where("walk_id <= 5").select("walk_id").distinct()
    assert t.classify_walks(marked=some, extra_edges=True).count() <= 4
    t.save(str(tmp_path / "saved"))
    back = Trajectory.load(spark, str(tmp_path / "saved"))
    assert back.origin == t.origin and back.reduced.count() == t.reduced.count() and list(back.layouts.tables) == list(t.layouts.tables)
    assert sorted(map(tuple, back.classify_walks().collect())) == sorted(map(tuple, t.classify_walks().collect()))
    assert t.copy().origin == t.origin
    assert t.down_sample(50).points.count() < 200


def test_reachability_goes_on_until_nothing_is_new(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(60)] + [(60, 58, 1.0)], "src long, dst long, w double")
    got = walks.reachability(edges, spark.createDataFrame([(0,), (59,), (60,)], "id long"))
    assert {(r["a"], r["b"]) for r in got.collect()} == {(0, 59), (0, 60), (59, 60)}


def test_whole_complexes_follow_the_data_in_all_dimensions(spark):
    from sparktraj.plans import shapes

    marks, lists, alpha = shapes.whole(spark, "/root/testdata/sf0.001")
    assert {len(r["x"]) for r in marks.collect()} == {64} and marks.count() == 50
    assert {r["n"] for r in lists.groupBy("src").agg(F.count("*").alias("n")).collect()} == {30} and alpha > 0
