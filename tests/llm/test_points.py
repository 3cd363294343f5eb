"""Problems 1 to 3 on small clouds: brute force, ties, copies, dirty and empty tables, hot groups."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktraj.llm import blocks, clusters, common, knn, subset

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, x array<double>, file_id int, events_sel long, acquired_at timestamp, ingested_at timestamp, extra string"


def table(spark, rows):
    """rows: (id, x) or (id, x, minutes)."""
    return spark.createDataFrame([(r[0], r[1], 1, r[0], T0, (T0 + dt.timedelta(minutes=r[2])) if len(r) > 2 and r[2] is not None else (None if len(r) > 2 else T0), "x") for r in rows], SCHEMA)


def vec(*head):
    return [float(v) for v in head] + [0.0] * (25 - len(head))


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=(700, 25)), rng.normal(size=(30, 25)) * 0.05 + 3, rng.normal(size=(12, 25)) * 30]
    x = np.r_[x, x[:60], x[:60] + 0.01, np.repeat(x[5:6], 40, 0)]
    return spark.createDataFrame([(int(i), r) for i, r in enumerate(x.tolist())], "id long, x array<double>").cache(), x


def distances(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return d


def test_usable_points(spark):
    bad = [(1, vec(1)), (1, vec(2), 5), (1, vec(9), None), (2, None), (3, []), (4, [1.0]), (5, vec(1)[:-1] + [None]), (6, vec(float("nan"))), (7, vec(3)), (7, vec(3)), (None, vec(1))]
    got = {r["id"]: r["x"][0] for r in common.usable_points(table(spark, bad)).collect()}
    assert got == {1: 2.0, 7: 3.0}


def test_near_lists_are_exact(cloud):
    df, x = cloud
    d = distances(x)
    want = {(a, int(b)) for a in range(len(x)) for b in np.lexsort((np.arange(len(x)), np.round(d[a], 12)))[:5] if d[a, b] <= 0.4}
    got = {(r["src"], r["dst"]) for r in knn.near_lists(df, 0.4, 5).collect()}
    assert got == want


def test_blocks_that_no_tree_cuts_are_split_without_loss(cloud, monkeypatch):
    monkeypatch.setattr(knn, "kd_build", lambda x, r, leaf: [(None, 0, -1, -1)])
    df, x = cloud
    router = knn.PartRouter(np.zeros((1, 25)), np.zeros(1))
    sent = knn.exchange(df, router, 0.4, block_rows=100)
    assert sent.select("s", "t").distinct().count() > 10
    got = {(r["src"], r["dst"]) for r in knn.in_blocks(sent, lambda i, y, s: blocks.links_top_k(i, y, 0.4, 10_000, s), "src long, dst long, dist double").collect()}
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(distances(x) <= 0.4))}


def test_search_recall(cloud):
    df, x = cloud
    got = {}
    for r in knn.search(df, df.where("id % 7 = 0"), 10).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    d = distances(x)
    hit = [len(got[a] & set(np.argsort(d[a], kind="stable")[:10].tolist())) if d[a, np.argsort(d[a])[10]] > d[a, np.argsort(d[a])[9]] else 10 for a in got]
    assert len(got) == len(range(0, len(x), 7)) and np.mean(hit) >= 9


def test_blocks_are_cut_until_they_fit(spark):
    """Samples of the blocks' own rows cut them where one sample of all couldn't, and near rows still meet."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 25)) * 2
    x[3000:] = x[:3000] + rng.normal(size=(3000, 25)) * 0.05
    df = as_points(spark, x)
    router = knn.PartRouter(np.zeros((1, 25)), np.zeros(1))
    large, blocks = knn.cut_large(df, router, 0.4, block_rows=300)
    assert large == {} and blocks > 20
    got = list(router.route(x, 0.4))
    where = {}
    for block, idx in got:
        for i in idx:
            where.setdefault(int(i), set()).add(block)
    assert len(got) > 20 and max(len(i) for _, i in got) <= 300 and sum(len(i) for _, i in got) < 5 * len(x)
    near = ((x[:3000] - x[3000:]) ** 2).sum(1) <= 0.16
    assert near.sum() > 1000 and all(where[i] & where[i + 3000] for i in np.nonzero(near)[0])


def test_router_keeps_near_rows_together():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 25))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 25)) * 0.05
    router = knn.PartRouter.fit(x, 60_000)
    assert len(router.b) > 3
    where = {}
    for block, idx in router.route(x, 0.4):
        for i in idx:
            where.setdefault(int(i), set()).add(block)
    near = ((x[:1500] - x[1500:]) ** 2).sum(1) <= 0.16
    assert near.sum() > 500 and all(where[i] & where[i + 1500] for i in np.nonzero(near)[0])


def test_linked_groups(cloud):
    df, x = cloud
    d, n = distances(x), len(x)
    label = np.arange(n)
    while True:
        new = np.array([min(label[i], label[d[i] <= 0.4].min(initial=n)) for i in range(n)])
        if (new == label).all():
            break
        label = new
    size = np.bincount(label, minlength=n)
    want = {(int(label[i]), i) for i in range(n) if size[label[i]] >= 3}
    assert {(r["cluster_key"], r["id"]) for r in clusters.linked_groups(df, 0.4).collect()} == want


def test_mixture_describes_separate_groups(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(size=(400, 25)), rng.normal(size=(300, 25)) + 6]
    df = spark.createDataFrame([(int(i), r) for i, r in enumerate(x.tolist())], "id long, x array<double>")
    model, _, n = clusters.fit(df, components=(2, 4))
    got = clusters.assignments(df, model).toPandas()
    assert n == 700 and not set(got["component"][got["id"] < 400]) & set(got["component"][got["id"] >= 400])
    told = clusters.describe(clusters.assignments(df, model)).collect()
    assert sum(r["size"] for r in told) == 700 and all(1 <= len(r["typical_ids"]) <= 5 for r in told)


@pytest.mark.parametrize("leaf,most", [(20_000, 512), (60, 16)])
def test_cover_and_isolated(cloud, leaf, most, monkeypatch):
    monkeypatch.setattr(subset, "LEAF_ROWS", leaf)
    monkeypatch.setattr(subset, "WIDTH", most)
    df, x = cloud
    chosen, rows, tree = subset.cover(df, 8.0)
    ids = [r["id"] for r in chosen.collect()]
    d = distances(x)
    np.fill_diagonal(d, 0)
    assert len(ids) == len(set(ids)) and (d[:, ids].min(1) <= 8.0).all()
    np.fill_diagonal(d, np.inf)
    assert {r["id"] for r in subset.isolated(chosen, rows, tree, 8.0).collect()} == set(np.nonzero(d.min(1) > 8.0)[0].tolist())


def test_varied_subset(cloud):
    df, x = cloud
    got = [r["id"] for r in subset.varied_subset(df, 60).orderBy("pick").collect()]
    assert len(set(got)) == 60
    assert {int(i) for i in range(730, 742)} <= set(got)  # the lone rows
    assert len({tuple(x[i]) for i in got}) == 60  # no copies
    assert subset.varied_subset(df, 900).count() <= len({tuple(r) for r in x})


def test_empty_and_single(spark):
    for rows in ([], [(1, vec(1))], [(1, None)]):
        p = common.usable_points(table(spark, rows)).select("id", "x")
        assert knn.near_lists(p, 0.4, 5).count() == 0
        assert clusters.linked_groups(p, 0.4).count() == 0
        alone = [r["id"] for r in subset.isolated(*subset.cover(p, 8.0), 8.0).collect()]
        assert alone == ([1] if rows == [(1, vec(1))] else [])
        assert subset.varied_subset(p, 3).count() == len(alone)
        assert knn.search(p, p, 3).count() == 0


def test_infinite_values_and_copies(spark):
    p = common.usable_points(table(spark, [(1, vec(float("inf"))), (2, vec(0)), (3, vec(0)), (4, vec(0)), (5, vec(0.1))])).select("id", "x")
    assert {(r["src"], r["dst"]) for r in knn.near_lists(p, 0.4, 2).collect()} == {(2, 3), (2, 4), (3, 2), (3, 4), (4, 2), (4, 3), (5, 2), (5, 3)}
    assert {(r["cluster_key"], r["id"]) for r in clusters.linked_groups(p, 0.4).collect()} == {(2, i) for i in (2, 3, 4, 5)}
    assert {r["id"] for r in subset.isolated(*subset.cover(p, 8.0), 8.0).collect()} == {1}


def test_a_third_of_the_rows_equal(spark):
    rng = np.random.default_rng(9)
    x = np.r_[np.repeat(rng.normal(size=(1, 25)), 2000, 0), rng.normal(size=(3000, 25))]
    df = spark.createDataFrame([(int(i), r) for i, r in enumerate(x.tolist())], "id long, x array<double>")
    got = knn.near_lists(df, 0.4, 5)
    assert got.where("src < 2000").count() == 10_000
    assert clusters.linked_groups(df, 0.4).where("id < 2000").agg(F.count("*"), F.max("cluster_key")).first()[:] == (2000, 0)


def test_subsets_cover_better_than_chance(spark):
    """Of 3,000 rows in groups of very unequal size: how far the farthest row is from 40 chosen ones."""
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(size=(2700, 25)) * 0.3, rng.normal(size=(280, 25)) + 4, rng.normal(size=(20, 25)) * 6]
    ids = [r["id"] for r in subset.varied_subset(as_points(spark, x), 40).collect()]

    def radius(chosen):
        return np.sqrt(((x[:, None] - x[chosen][None]) ** 2).sum(2)).min(1).max()

    greedy, d = [0], np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(greedy) < 40:
        greedy.append(int(d.argmax()))
        d = np.minimum(d, np.sqrt(((x - x[greedy[-1]]) ** 2).sum(1)))
    assert radius(ids) < 0.8 * np.median([radius(rng.choice(3000, 40, False)) for _ in range(9)]) and radius(ids) < 2.5 * radius(greedy)


def latent(n, seed=8):
    """n rows whose 25 channels follow one latent dimension."""
    u = np.random.default_rng(seed).uniform(-1, 1, size=(n, 1))
    return u @ np.linspace(0.5, 1.5, 25)[None]


def as_points(spark, x):
    return spark.createDataFrame([(int(i), r) for i, r in enumerate(x.tolist())], "id long, x array<double>")


def test_varied_subset_goes_on_when_residuals_run_out(spark):
    x = latent(600)
    got = [r["id"] for r in subset.varied_subset(as_points(spark, x), 150).orderBy("pick").collect()]
    assert len(got) == len(set(got)) == 150


def test_varied_subset_takes_all_distinct_rows_before_it_ends(spark):
    x = np.r_[latent(40), latent(40)[:20], latent(10) + 1e-5, latent(1) + 1e3, [vec(float("inf"))]]
    got = [r["id"] for r in subset.varied_subset(as_points(spark, x), 100).collect()]
    assert len({tuple(x[i]) for i in got}) == len(got) == len({tuple(r) for r in x})


def test_spread_width_is_not_widened_by_far_rows(spark):
    x = np.random.default_rng(3).normal(size=(2000, 25))
    mad = np.median(np.abs(x - np.median(x, 0)), 0)
    far = x.copy()
    far[:10] = 1e3
    for rows in (x, far):
        width = subset.spread_width(subset._packed(as_points(spark, rows), 25), 25)
        assert width == pytest.approx(0.5 * np.sqrt((mad**2).sum()), rel=0.05)


def test_leaves_hold_what_is_copied_into_them():
    """A tree's leaves are as small as asked for with the rows that come in both sides, also beside far rows, and at few copies."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(20_000, 25)) * np.linspace(1.9, 0.8, 25)
    x[:60] *= 15
    sizes = [len(i) for _, i in blocks.kd_route(blocks.kd_build(x, 0.4, 1000), x, 0.4)]
    assert max(sizes) <= 1000 and sum(sizes) < 3 * len(x)


@pytest.mark.parametrize("r", [0.4, 2.5])
def test_near_pairs_come_once(cloud, monkeypatch, r):
    x = np.r_[cloud[1], [vec(1e150), vec(-1e150), vec(1e150)]]
    side = np.arange(len(x)) % 3
    d = np.triu(distances(x) <= r, 1)
    for cell, most in ((256, 1_000_000), (8, 50)):
        monkeypatch.setattr(blocks, "CELL_ROWS", cell)
        monkeypatch.setattr(blocks, "PAIRS", most)
        for s, want in ((None, d), (side, d & (side[:, None] != side[None]))):
            got = [(a, b) for i, j, _ in blocks.near_pairs(x, r, s) for a, b in zip(i.tolist(), j.tolist())]
            assert len(got) == len(set(got)) and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(want))))


def test_a_batch_leaves_as_one_batch():
    block, row = knn.blocks_and_rows([(7, np.array([2, 0])), (3, np.array([1]))])
    assert block.tolist() == [7, 7, 3] and row.tolist() == [2, 0, 1] and len(knn.blocks_and_rows([])[0]) == 0


def test_cover_is_chosen_by_tournaments(cloud, monkeypatch):
    """Nominations of tasks and of regions' nodes are merged up a tree, with the span of earlier winners out, over several rounds."""
    calls, real = [], subset.regional_round
    monkeypatch.setattr(subset, "regional_round", lambda state, last, *a: calls.append(last) or real(state, last, *a))
    monkeypatch.setattr(subset, "WIDTH", 4)
    monkeypatch.setattr(subset, "CHUNK", 8)
    df, x = cloud
    chosen, _, _ = subset.cover(df.repartition(5), 8.0)
    ids = [r["id"] for r in chosen.collect()]
    assert calls and max(calls) > 0 and len(ids) == len(set(ids))
    assert (np.sqrt(((x[:, None] - x[ids][None]) ** 2).sum(2)).min(1) <= 8.0).all()
    d = distances(x[ids])
    assert (d.min(1) > 8.0).sum() >= 12 and len(ids) < len(x) // 8  # the lone rows among them, and not many more
