"""Problems 4 to 6 on small tables: brute force, ties, dirty and empty tables, hot groups."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktraj.llm import mixing, percentiles, quotas, runs

T0 = dt.datetime(2024, 1, 1)
ROWS = "key string, vals array<double>"


def test_percentiles_over_several_ranges(spark):
    rng = np.random.default_rng(1)
    a = np.r_[rng.normal(size=9000), np.full(4000, 0.25)]
    b = np.round(rng.exponential(size=700), 1)
    rows = [("a", [float(v)]) for v in a] + [("b", [float(v)]) for v in b] + [("one", [3.0]), (None, [1.0]), (None, [2.0]), ("none", [None]), ("none", [float("nan")]), ("none", [float("inf")])]
    got = {(r["key"], r["p"]): (r["value"], r["n"]) for r in percentiles.exact(spark.createDataFrame(rows, ROWS), range_rows=500).collect()}
    for p in percentiles.PROBS:
        assert got["a", p] == (pytest.approx(np.quantile(a, p), abs=1e-12), 13_000)
        assert got["b", p] == (pytest.approx(np.quantile(b, p), abs=1e-12), 700)
        assert got["one", p] == (3.0, 1) and got[None, p][0] == pytest.approx(1 + p)
    assert not [k for k in got if k[0] == "none"]


def test_percentiles_of_channels_and_empty(spark):
    x = np.random.default_rng(2).normal(size=(300, 3))
    got = {(r["channel"], r["p"]): r["value"] for r in percentiles.exact(spark.createDataFrame([("k", r) for r in x.tolist()], ROWS), 3).collect()}
    assert all(got[c, p] == pytest.approx(np.quantile(x[:, c], p)) for c in range(3) for p in percentiles.PROBS)
    assert percentiles.exact(spark.createDataFrame([], ROWS)).count() == 0


def test_merged_states_stay_within_their_bound(spark):
    rng = np.random.default_rng(3)
    days = {f"d{i}": np.r_[rng.normal(i, 1, 3000), np.full(500, 2.0)] for i in range(5)}
    rows = [("k", d, float(v)) for d, vs in days.items() for v in vs]
    state = percentiles.state(spark.createDataFrame(rows, "key string, part string, value double"), 0.01)
    assert state.count() == 5 and max(len(r["items"]) for r in state.collect()) <= 102
    every = np.sort(np.concatenate(list(days.values())))
    for r in percentiles.merged(state, epsilon=0.01).collect():
        lo, hi = np.searchsorted(every, r["value"], "left"), np.searchsorted(every, r["value"], "right")
        off = max(0, lo - r["p"] * r["n"], r["p"] * r["n"] - hi)
        assert r["n"] == len(every) and off <= r["max_rank_error"]


PLANS = "plan_name string, labels_name string, label string, share double, min_rows long, n_total long"


def test_quotas(spark):
    plans = spark.createDataFrame([("p", "s", "Big", 0.6, 5, 100), ("p", "s", " small ", 0.4, 2, 100), ("p", "s", "none", 0.0, 3, 100), ("p", "s", None, 0.5, 3, 100), ("q", "t", "big", None, None, 10)], PLANS)
    pop = spark.createDataFrame([(i, "s", "big", None if i % 3 == 0 else i % 5) for i in range(1000)] + [(2000 + i, "s", "small", 1) for i in range(10)], "id long, labels_name string, norm string, file_id int")
    sample, report, files = quotas.draw(plans, pop)
    got = {(r["plan_name"], r["label"]): (r["wanted"], r["available"], r["taken"], r["gap"]) for r in report.collect()}
    assert got == {("p", "Big"): (60, 1000, 60, 0), ("p", " small "): (40, 10, 10, 30), ("p", "none"): (3, 0, 0, 3), ("q", "big"): (0, 0, 0, 0)}
    ids = [r["id"] for r in sample.collect()]
    assert len(ids) == len(set(ids)) == 70
    by_file = {r["file"]: r["taken"] for r in files.where("plan_name = 'p'").collect()}
    assert sum(by_file.values()) == 70 and by_file["1"] >= 10 and by_file["null"] > 0
    shares = files.where("plan_name = 'p'").agg(F.sum("target_share"), F.sum("actual_share"), F.sum("gap")).first()
    assert list(shares) == pytest.approx([1, 1, 0], abs=1e-9)
    sample, report, _ = quotas.draw(plans.limit(0), pop.limit(0))
    assert sample.count() == 0 and report.count() == 0
    assert quotas.draw(plans, pop.limit(0))[1].where("gap > 0").count() == 3


def test_rake_meets_both_margins():
    rng = np.random.default_rng(0)
    a, b = np.repeat(np.arange(4), 5), np.tile(np.arange(5), 4)
    w = quotas.rake(rng.integers(1, 100, 20), [np.array([10.0, 20, 30, 40]), np.array([20.0] * 5)], [a, b])
    assert np.allclose(np.bincount(a, w), [10, 20, 30, 40], rtol=1e-3) and np.allclose(np.bincount(b, w), 20, rtol=1e-3)


def test_raked_rates_respect_caps():
    rng = np.random.default_rng(0)
    for _ in range(50):
        tokens = rng.integers(10, 2000, 40).astype(float)
        source, lang, size = rng.integers(0, 5, 40), rng.integers(0, 4, 40), rng.integers(0, 3, 40)
        source[:5], lang[:4], size[:3] = range(5), range(4), range(3)
        have, cap = np.bincount(source, tokens, 5), rng.integers(1, 9, 5).astype(float)
        target = have * rng.uniform(0.1, 1.5, 5) * cap
        r = mixing.raked_rates(tokens, source, lang, size, target, cap)
        assert (r <= cap[source] + 1e-9).all()
        assert np.allclose(np.bincount(source, r * tokens, 5), np.minimum(target, have * cap), rtol=1e-3)


DOCS = "doc_id long, text string, source string, lang string, extra int"
TARGETS = "mix_name string, source string, weight double, max_repeats int, total_tokens long"


def test_mix(spark):
    docs = [(i, "word " * (20 + i % 50), "big" if i < 400 else "small", ["en", None, "de"][i % 3], 1) for i in range(410)] + [(1000, None, "big", "en", 1), (1001, "", "big", "en", 1), (1002, "lost words", None, "en", 1)]
    targets = [("m", "big", 0.5, 1, 4000), ("m", "small", 0.4, 3, 4000), ("m", "gone", 0.1, 3, 4000), ("m", None, 0.1, 3, 4000)]
    copies, report = mixing.mix(spark.createDataFrame(targets, TARGETS), spark.createDataFrame(docs, DOCS))
    got = {r["source"]: r for r in report.collect()}
    assert 2000 - 70 <= got["big"]["actual_tokens"] <= 2000 and got["big"]["most_copies"] == 1
    assert got["small"]["most_copies"] <= 3 and got["small"]["actual_tokens"] <= 1600
    assert got["small"]["available"] * 3 <= 1600 or got["small"]["actual_tokens"] >= 1600 - 70
    assert got["gone"]["actual_tokens"] == 0 and got["gone"]["gap_tokens"] == 400
    assert not {r["doc_id"] for r in copies.collect()} & {1000, 1001, 1002}
    empty = mixing.mix(spark.createDataFrame(targets, TARGETS), spark.createDataFrame([], DOCS))
    assert empty[0].count() == 0 and empty[1].count() == 3


STEPS = "origin_name string, walk_id long, step int, v long, visited_at timestamp, logged_at timestamp, extra string"


def steps(spark, rows):
    return spark.createDataFrame([("o", w, s, v, T0 + dt.timedelta(seconds=s) if s is not None else None, T0 + dt.timedelta(seconds=t), "") for w, s, v, t in rows], STEPS)


def cloud(spark):
    return spark.createDataFrame([(i, [i * 0.3] + [0.0] * 24) for i in range(10)] + [(50, [100.0] + [0.0] * 24)], "id long, x array<double>")


def test_runs(spark):
    rows = [(1, 1, 0, 0), (1, 2, 1, 0), (1, 3, 5, 0), (1, 3, 2, 9), (1, 4, None, 0), (1, 6, 3, 0), (1, 7, 50, 0), (1, 8, 50, 0), (1, 9, 77, 0), (1, 10, 77, 0), (1, 11, 78, 0), (2, 1, 78, 0), (2, 1, 78, 0), (None, 1, 1, 0), (3, None, 1, 0), (4, 1, None, 0)]
    got = {(r["walk_id"], r["first_step"]): (r["last_step"], r["n_steps"], r["v"], r["seconds"]) for r in runs.collapse(steps(spark, rows), cloud(spark)).collect()}
    assert got == {(1, 1): (6, 4, 0, 5.0), (1, 7): (8, 2, 50, 1.0), (1, 9): (10, 2, 77, 1.0), (1, 11): (11, 1, 78, 0.0), (2, 1): (1, 1, 78, 0.0)}


def test_runs_over_partition_borders(spark):
    rng = np.random.default_rng(5)
    rows = [(1, s, int(rng.integers(0, 2)) if s < 3000 else int(rng.integers(0, 10)) * 3 % 11, 0) for s in range(6000)] + [(w, s, int(rng.integers(0, 10)), 0) for w in range(2, 40) for s in range(50)]
    got = sorted((r["walk_id"], r["first_step"], r["last_step"], r["n_steps"]) for r in runs.collapse(steps(spark, rows), cloud(spark)).collect())
    want, x = [], {i: i * 0.3 for i in range(10)}
    for w in sorted({r[0] for r in rows}):
        of = sorted((s, v) for a, s, v, _ in rows if a == w)
        first, last, n, at = of[0][0], of[0][0], 1, of[0][1]
        for s, v in of[1:]:
            if v == at or v in x and at in x and abs(x[v] - x[at]) <= 0.4:
                last, n = s, n + 1
            else:
                want.append((w, first, last, n))
                first, last, n = s, s, 1
            at = v
        want.append((w, first, last, n))
    assert got == sorted(want)


def test_runs_of_nothing(spark):
    assert runs.collapse(steps(spark, []), cloud(spark)).count() == 0
    assert runs.collapse(steps(spark, [(1, 1, 5, 0), (1, 2, 6, 0)]), cloud(spark).limit(0)).count() == 2


def test_segment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        d = np.where(rng.random(n) < 0.2, np.inf, rng.random(n) * 2)
        d = np.minimum(d, 1e6)
        starts = runs.segment(n, runs.Chain(d), 1.0)
        cost = lambda cut: sum(1.0 if i in cut else d[i] for i in range(1, n)) + 1.0
        best = min(cost({i for i in range(1, n) if m >> i & 1}) for m in range(0, 2**n, 2))
        assert starts[0] == 0 and cost(set(starts)) == pytest.approx(best)


def within(x, w):
    m = (x * w[:, None]).sum(0) / w.sum()
    return (((x - m) ** 2).sum(1) * w).sum()


def test_segments_about_means_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 9))
        x, w = np.cumsum(rng.normal(size=(n, 3)) * 0.3, 0), rng.integers(1, 4, n).astype(float)
        starts = runs.segment(n, runs.Mean(x, w), 0.2)
        cost = lambda cut: sum(within(x[a:z], w[a:z]) + 0.2 for a, z in zip(cut, [*cut[1:], n]))
        best = min(cost([0, *[i for i in range(1, n) if m >> i & 1]]) for m in range(0, 2**n, 2))
        assert starts[0] == 0 and cost(starts) == pytest.approx(best)


def test_mean_runs_end_where_a_drift_has_gone_too_far(spark):
    """0, 0.3, 0.6, ... are all near the one before: one chain, but several runs about means."""
    rows = [(1, s, s, 0) for s in range(10)] + [(1, s, 3, 0) for s in range(10, 400)] + [(2, 1, 50, 0), (2, 2, 50, 0), (2, 3, 77, 0), (3, 1, 77, 0), (4, 1, None, 0)]
    assert runs.collapse(steps(spark, rows), cloud(spark)).where("walk_id = 1").count() == 2
    got = sorted(tuple(r)[:4] for r in runs.mean_runs(steps(spark, rows), cloud(spark)).collect())
    v = np.array([0.3 * s for s in range(10)] + [0.9])[:, None]
    w = np.r_[np.ones(10), 390.0]
    drift = runs.segment(10, runs.Mean(v[:10], w[:10]), 0.08)
    want = [(1, a, z - 1, z - a) for a, z in zip(drift, [*drift[1:], 10])] + [(1, 10, 399, 390), (2, 1, 2, 2), (2, 3, 3, 1), (3, 1, 1, 1)]
    assert len(drift) > 2 and got == sorted(want)
    assert runs.mean_runs(steps(spark, []), cloud(spark)).count() == 0
    assert runs.mean_runs(steps(spark, [(1, 1, 5, 0), (1, 2, 6, 0)]), cloud(spark).limit(0)).count() == 2


def test_mix_fills_until_nothing_fits(spark):
    docs = [(i, "word " * 2 ** (i % 12), "one", "en", 1) for i in range(36)]
    targets = [(f"m{k}", "one", 0.5, 1, 11_000) for k in range(60)]
    copies, report = mixing.mix(spark.createDataFrame(targets, TARGETS), spark.createDataFrame(docs, DOCS))
    taken, gaps = {}, {r["mix_name"]: r["gap_tokens"] for r in report.collect()}
    for r in copies.collect():
        taken.setdefault(r["mix_name"], set()).add(r["doc_id"])
    sizes = {r["doc_id"]: r["n_tokens"] for r in mixing.token_counts(spark.createDataFrame(docs, DOCS)).collect()}
    assert not [m for m in gaps if min(n for i, n in sizes.items() if i not in taken[m]) <= gaps[m]]
