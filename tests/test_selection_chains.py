"""Filters, summaries, p-values, nearest neighbours by parts, and the chains, on small tables with gaps and ties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import chains as ch
from pathloom.operators import selection as sel
from pathloom.operators.joins import mutual_nearest
from pathloom.operators.labelling import vote_weights
from pathloom.operators.redundancy import distance_correlation, pairwise_kernel, t_tail


def test_filters_keep_nulls_only_where_asked(spark):
    rows = spark.createDataFrame([(1, "likely_normal", " Study "), (2, "uncertain", "historical"), (3, "highly_anomalous", None), (4, None, "other")], "i int, l string, p string")
    ids = lambda df: {r.i for r in df.collect()}
    assert ids(sel.label_filter(rows, "l")) == {1, 2, 3, 4} and ids(sel.label_filter(rows, "l", "anomalies")) == {3} and ids(sel.label_filter(rows, "l", "non_normal")) == {2, 3}
    assert ids(sel.label_filter(rows, "l", "specific", ["uncertain"])) == {2} and ids(sel.label_filter(rows, "l", "specific")) == set()
    assert ids(sel.provenance_filter(rows, "p", "study")) == {1} and ids(sel.provenance_filter(rows, "p")) == {1, 2}
    with pytest.raises(ValueError):
        sel.label_filter(rows, "l", "none")


def test_columns(spark):
    df = spark.createDataFrame([], "b string, A int, c double, `x.y` decimal(5,2)")
    assert sel.numeric_columns(df, ["a"]) == ["c", "x.y"] and sel.ordered_columns(df, ["c", "zz"]).columns == ["c", "A", "b", "x.y"]
    assert sel.ordered_intersection([["c", "a", "c", "b"], ["b", "c"]]) == ["c", "b"] and sel.ordered_intersection([]) == []


def test_coverage_and_balance(spark):
    rows = spark.createDataFrame([("g", i, s) for i, n in ((1, 4), (2, 3), (3, 2), (None, 4)) for s in range(n)] + [("h", 9, 0)], "g string, i int, s int")
    assert {(r.g, r.i) for r in sel.covered_items(rows, ["g"], "i", "s").collect()} == {("g", 1), ("g", 2), ("h", 9)}
    scores = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", 100 + i, float(i)) for i in range(2)], "d string, i int, x double")
    got = sel.balanced_top(scores, "d", [F.desc("x"), F.col("i")], 6, ["a", "b"])
    assert sorted(r.i for r in got.collect()) == [6, 7, 8, 9, 100, 101]  # b has two only, a takes what is left
    assert sel.balanced_top(scores.limit(0), "d", [F.desc("x")], 6, ["a", "b"]).count() == 0


def test_joins_of_metadata_and_weights(spark):
    left, right = spark.createDataFrame([(1, 5)], "k int, n int"), spark.createDataFrame([(1, 7, 8)], "k int, n int, m int")
    assert sel.joined_with_suffix(left, right, ["k"]).first().asDict() == {"k": 1, "n": 5, "n_graph": 7, "m": 8}
    w = spark.createDataFrame([(0,), (None,), (-3,), (9,)], "w int").select(sel.log_weight(F.col("w")).alias("x")).collect()
    assert [round(r.x, 9) for r in w] == [0.0, 0.0, 0.0, round(math.log(10), 9)]
    s = sel.described(spark.createDataFrame([(1.0,), (None,), (4.0,)], "x double"), ["x"]).first()
    assert (s["count"], s.mean, s.min, s.q25, s.median, s.max) == (2, 2.5, 1.0, 1.75, 2.5, 4.0)
    assert sel.described(spark.createDataFrame([], "x double"), ["x"]).first()["count"] == 0


def test_t_tail():
    # with one degree of freedom the tail has a closed form, with two as well
    for t in (0.0, 0.3, 1.0, 4.0, 50.0):
        assert t_tail(np.array([t]), np.array([1.0]))[0] == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-10)
        assert t_tail(np.array([t]), np.array([2.0]))[0] == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-10)
    assert np.isnan(t_tail(np.array([1.0]), np.array([0.0])))[0] and t_tail(np.array([np.inf]), np.array([5.0]))[0] == 0


def test_weights_when_no_method_varies(spark):
    rows = spark.createDataFrame([(0, 1), (0, 1)], "a int, b int")
    assert {r.method: r.weight for r in vote_weights(rows, ["a", "b"]).collect()} == {"a": 0.5, "b": 0.5}
    assert {r.method for r in vote_weights(spark.createDataFrame([(0, 1), (1, 1)], "a int, b int"), ["a", "b"]).collect()} == {"a"}


def test_mutual_neighbours_do_not_depend_on_parts(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("xy"), [float(rng.randrange(6)), float(rng.randrange(6))]) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, g string, v array<double>")
    near = {}
    for i, g, v in rows:
        others = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, h, w in rows if h == g and j != i)
        near[i] = {j for _, j in others[:4]}
    want = {(a, b) for a in near for b in near[a] if a < b and a in near[b]}
    for block in (7, 50, 5000):
        assert {(r.a, r.b) for r in mutual_nearest(df, "i", "v", "g", 4, block).collect()} == want, block
    lonely = set(near) - {x for p in want for x in p}
    assert {(r.a, r.b) for r in mutual_nearest(df, "i", "v", "g", 4, 50, fallback=True).collect()} == want | {(min(a, b), max(a, b)) for a in lonely for b in near[a]}


def test_distance_correlation_in_one_block_is_the_measure(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=90)
    y = x**2 + 0.1 * rng.normal(size=90)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i long, x double, y double")
    assert pairwise_kernel(df, ["x", "y"], "i", 1000, "dcor").first().r == pytest.approx(distance_correlation(x, y))
    assert 0 < pairwise_kernel(df, ["x", "y"], "i", 30, "nmi").first().r <= 1


def test_components_hold_the_variance(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 2))
    x = np.c_[base, base @ [[1.0], [2.0]] + 1e-3 * rng.normal(size=(300, 1))]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    turned, names = ch.pca(df, ["a", "b", "c"])
    assert names == ["pc1", "pc2"]
    got = np.array([[r.pc1, r.pc2] for r in turned.select(*names).collect()])
    lam = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.var(got, axis=0, ddof=1) == pytest.approx(lam[:2]) and [r.within_99 for r in ch.scree(df, ["a", "b", "c"]).collect()] == [True, True, False]


def test_labels_from_detectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "g", *map(float, rng.normal(size=2)), None) for i in range(200)] + [(900 + i, "g", 40.0 + i, -60.0, 1.0) for i in range(3)] + [(990, "g", None, 1.0, None)]
    df = spark.createDataFrame(rows, "i long, g string, a double, b double, label double")
    got = {r.i: r.label for r in ch.label_windows(df, "g", "i", ["a", "b"], clusters=(2, 3)).collect()}
    assert len(got) == 203 and all(got[900 + i] in ("likely_anomalous", "highly_anomalous") for i in range(3))
    assert sum(v == "likely_normal" for v in got.values()) > 120
    with pytest.raises(ValueError):
        ch.label_windows(df.limit(20), "g", "i", ["a", "b"])


def test_deploy_and_ensemble(spark):
    rng = random.Random(1)
    source = spark.createDataFrame([(i, float(i % 2), 3.0 * (i % 2) + rng.gauss(0, 1), rng.random()) for i in range(200)], "i long, y double, a double, b double")
    target = spark.createDataFrame([(i, 5.0 + 6.0 * (i % 2) + rng.gauss(0, 1), None if i == 3 else rng.random()) for i in range(40)], "i long, a double, b double")
    got = {r.i: r for r in ch.deploy(source, target, ["a", "b"], ["i"]).collect()}
    assert len(got) == 40 and sum(r.pred == i % 2 for i, r in got.items()) >= 34
    assert {r.pred for r in ch.deploy(source.filter("y = 0"), target, ["a", "b"], ["i"]).collect()} == {0}
    e = ch.ensemble(spark.createDataFrame([(1, 0.2), (1, 0.4), (2, None)], "w int, s double"), ["w"], "s").collect()
    assert {r.w: (r.mean_score and round(r.mean_score, 9), r.n_models) for r in e} == {1: (0.3, 2), 2: (None, 0)}


def test_mutual_information_is_exact_and_makes_no_matrix_of_all_rows():
    import time

    from pathloom.operators import redundancy as rd

    def direct(x, y, k=3):
        x, y = [(v - v.mean()) / (v.std() or 1.0) for v in (x, y)]
        dx, dy = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
        d = np.maximum(dx, dy)
        np.fill_diagonal(d, np.inf)
        r = np.partition(d, k - 1, axis=1)[:, k - 1]
        nx, ny = [np.maximum((v < r[:, None]).sum(axis=1) - 1, 0) + 1.0 for v in (dx, dy)]
        psi = lambda v: rd._digamma(np.asarray(v, dtype=float))
        return max(0.0, float(psi([len(x)])[0] + psi([k])[0] - (psi(nx) + psi(ny)).mean()))

    rng = np.random.default_rng(6)
    for n in (4, 9, 300, 700):
        for values in (1, 2, 7, 10_000):  # many equal values, and hardly any
            x, y = rng.integers(0, values, n) * 0.1, rng.integers(0, 50, n) / 3 + rng.integers(0, values, n)
            assert rd.mutual_information(x, y) == pytest.approx(direct(x, y), abs=1e-12)
            assert rd.mutual_information(x, x) == pytest.approx(direct(x, x), abs=1e-12)
    x = rng.normal(size=30_000)
    began = time.process_time()
    rd.mutual_information(x, 0.5 * x + rng.normal(size=30_000))
    assert time.process_time() - began < 8  # 900 million distances are 14 GB


def test_deployed_drops_copies_once_and_fits_domains_side_by_side(spark, data, monkeypatch):
    import threading

    from pathloom.plans import chain_ops as co

    kept, threads = [], set()
    real = co.cut
    monkeypatch.setattr(co, "cut", lambda df: kept.append(df.columns) or real(df))
    met = threading.Barrier(2, timeout=60)

    def deploy(source, target, columns, keep):
        threads.add(threading.get_ident())
        met.wait()  # two domains at least are in work at once
        return target.select(*keep)

    monkeypatch.setattr(co.ch, "deploy", deploy)
    co.deployed(spark, data)
    assert len(kept) == 1 and len(threads) == 2
