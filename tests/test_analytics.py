"""Kernels, alignment, joins, labelling, models and files on small known cases."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions.stats import correlation
from pathloom.operators import alignment as al
from pathloom.operators import detectors as de
from pathloom.operators import evaluation as ev
from pathloom.operators import joins as j
from pathloom.operators import labelling as lb
from pathloom.operators import models as mo
from pathloom.operators import ordered as o
from pathloom.operators import redundancy as rd
from pathloom.operators import relations as rl
from pathloom.sources import files

T0 = dt.datetime(2025, 7, 1)
at = lambda m: T0 + dt.timedelta(minutes=m)


def test_sessions_at_equal_and_larger_gaps(spark):
    df = spark.createDataFrame([("d", T0), ("d", at(120)), ("d", at(240) + dt.timedelta(seconds=1)), ("d", None)], "domain string, w timestamp")
    got = [(r.w, r.event_id) for r in o.sessions(df, ["domain"], "w", 120, "domain").orderBy("w").collect()]
    assert [e for _, e in got] == ["d_evt_001", "d_evt_001", "d_evt_002"]


def test_interval_join_takes_the_later_of_overlapping_events(spark):
    rows = spark.createDataFrame([(1, "d", at(0)), (2, "d", at(10)), (3, "d", at(3000)), (4, "e", at(0)), (5, "d", None)], "i int, k string, t timestamp")
    spans = spark.createDataFrame([("d", at(-5), at(10), "a", 1), ("d", at(10), at(2999), "b", 2)], "k string, s timestamp, e timestamp, name string, n int")
    closed = {r.i: r.name for r in j.interval_join(rows, spans, ["k"], "t", "s", "e", "name", "n").collect()}
    assert closed == {1: "a", 2: "b", 3: None, 4: None, 5: None}
    half = {r.i: r.name for r in j.interval_join(rows, spans, ["k"], "t", "s", "e", "name", "n", closed=False).collect()}
    assert half[2] == "b"


def test_nearest_join_tolerance_and_ties(spark):
    left = spark.createDataFrame([(1, "k", at(0)), (2, "k", at(100)), (3, "x", at(0))], "i int, k string, t timestamp")
    right = spark.createDataFrame([("k", at(-5), "early"), ("k", at(5), "late"), ("k", at(111), "far")], "k string, t timestamp, name string")
    got = {r.i: r.near_name for r in j.nearest_join(left, right, ["k"], "t", ["name"], 600, "name").collect()}
    assert got == {1: "early", 2: None, 3: None}


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(tuple(r) for r in j.replace_by_key(old, new, ["k"]).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(tuple(r) for r in j.keep_last(old.union(new), ["k"], [F.col("v")]).collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    row = df.agg(correlation(F.col("a"), F.col("b")).alias("ab"), correlation(F.col("a"), F.col("c")).alias("ac")).first()
    assert row.ab == pytest.approx(1) and row.ac is None
    pairs = {(r.feature_a, r.feature_b): r.r for r in rd.pearson_pairs(df, ["a", "b", "c"]).collect()}
    assert pairs == {("a", "b"): pytest.approx(1), ("a", "c"): 0.0, ("b", "c"): 0.0}
    assert rd.usable_columns(df, ["a", "b", "c"]) == ["a", "b"]


def test_redundancy_kernels():
    corr = np.array([[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1.0]])
    assert rd.vif(corr) == pytest.approx([1 / 0.19, 1 / 0.19, 1])
    assert rd.condition_number(corr) == (pytest.approx(math.sqrt(19)), "low")
    assert list(rd.average_linkage(1 - corr, 0.3)) == [1, 1, 2]
    assert rd.mrmr(np.array([0.9, 0.89, 0.2]), corr, ["a", "b", "c"], 3)[0] == "a"
    x = np.linspace(0, 1, 60)
    assert rd.distance_correlation(x, 3 * x + 1) == pytest.approx(1)
    assert rd.distance_correlation(x, np.ones(60)) == 0
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=600), rng.normal(size=600)
    assert rd.mutual_information(a, b) < 0.08
    assert rd.mutual_information(a, 0.9 * a + math.sqrt(1 - 0.81) * b) == pytest.approx(-0.5 * math.log(1 - 0.81), abs=0.12)


def test_alignment_moves_the_covariance(spark):
    rng = np.random.default_rng(1)
    make = lambda m: spark.createDataFrame((rng.normal(size=(800, 3)) @ m + [1, 2, 3]).tolist(), "a double, b double, c double").withColumn("id", F.monotonically_increasing_id())
    s, t, cols = make(np.eye(3)), make(np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 3]])), ["a", "b", "c"]
    before, after = (al.covariance_gap(x, t, cols).first()[0] for x in (s, al.coral(s, t, cols)))
    assert after < 0.02 * before
    one, width = al.mmd_rbf(s, t, cols, "id", 200)
    two, _ = al.mmd_rbf(al.coral(s, t, cols), t, cols, "id", 200, width)
    assert two.first().mmd2 < one.first().mmd2
    assert al.gamma_upper(1, 2) == pytest.approx(math.exp(-2)) and al.gamma_upper(2.5, 1.0) == pytest.approx(0.8491450, abs=1e-6)


def test_canonical_correlations_of_a_known_mixture():
    cov = np.eye(4)
    cov[0, 2] = cov[2, 0] = 0.8
    assert al.canonical_correlations(cov, 2) == pytest.approx([0.8, 0], abs=1e-6)


def test_detectors_find_the_lone_point(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), "g", *map(float, v)) for i, v in enumerate(np.vstack([rng.normal(size=(150, 2)), [[9, 9]]]))]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    got = de.detect(df, "g", "id", ["x", "y"]).toPandas().set_index("id")
    for c in ("lof", "mcd_distance", "glosh"):
        assert got[c].idxmax() == 150, c
    forest = de.isolation_forest(df, "id", ["x", "y"], trees=60).toPandas().set_index("id")
    assert forest["iforest_score"].idxmax() == 150
    with pytest.raises(Exception, match="most_rows"):
        de.detect(df, "g", "id", ["x", "y"], most_rows=10).count()


def test_lof_against_its_definition():
    x = np.random.default_rng(3).normal(size=(40, 2))
    d, k = de._distances(x), 5
    near = [sorted(range(40), key=lambda q: d[p, q])[:k] for p in range(40)]
    kd = [d[p, near[p][-1]] for p in range(40)]
    lrd = [1 / np.mean([max(kd[q], d[p, q]) for q in near[p]]) for p in range(40)]
    assert de.local_outlier_factor(d, k) == pytest.approx([np.mean([lrd[q] for q in near[p]]) / lrd[p] for p in range(40)])


def test_thresholds_of_equal_weights(spark):
    row = spark.range(1).select(lb.vote_thresholds(F.array(*[F.lit(0.2)] * 5)).alias("t")).first().t
    assert (row.uncertain, row.likely, row.high) == pytest.approx((0.2, 0.6, 0.8))


def test_balanced_subsample_and_folds(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)] + [(5000, None)], "id long, y int")
    got = ev.balanced_subsample(df, "y", "id")
    assert {r.y: r["count"] for r in got.groupBy("y").count().collect()} == {0: 100, 1: 100}
    assert got.select("id").distinct().count() == 200
    folds = ev.fold_numbers(df.filter("y is not null"), "y", "id", 4).groupBy("y", "fold").count().collect()
    assert all(abs(r["count"] - (25 if r.y else 225)) < (25 if r.y else 40) for r in folds) and len(folds) == 8


def test_metrics_of_a_single_class(spark):
    df = spark.createDataFrame([("d", 0, 0.2, 0), ("d", 0, 0.4, 1)], "d string, y int, s double, p int")
    c = ev.confusion(df, ["d"], "y", "p").first()
    assert (c.precision_1, c.recall_1, c.f1_1, c.recall_0) == (0, 0, 0, 0.5)
    assert ev.average_precision(df, ["d"], "y", "s").first().average_precision == 0
    assert ev.calibration_error(df.limit(0), ["d"], "y", "s").count() == 0


def test_models_learn_and_calibrate(spark):
    rows = [(i, float(i % 2), float(i % 2) + 0.1 * (i % 7), float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y double, a double, b double")
    got = mo.out_of_fold(df, ["a", "b"], "id", "logistic", 2)
    assert got.count() == 400 and ev.average_precision(got, [], "y", "score").first()[0] > 0.95
    iso = [r.calibrated for r in mo.calibrate_isotonic(got, got, "score", "y").orderBy("score").collect()]
    assert all(x <= y + 1e-9 for x, y in zip(iso, iso[1:]))
    fitted = mo.fit(df, ["a", "b"], "logistic", regParam=0.1)
    explained = mo.linear_explanations(fitted, df, ["a", "b"], ["id"], 2).groupBy("id").agg(F.sum("shap").alias("s"))
    score = mo.scores(fitted, df, ["id"])
    gap = explained.join(score, "id").select((F.log(F.col("score") / (1 - F.col("score"))) - F.col("s")).alias("base")).agg(F.max("base") - F.min("base")).first()[0]
    assert gap < 1e-6


def test_tail_split_and_numbers(spark):
    df = spark.createDataFrame([(i, int(i in (3, 80, 85, 88, 95, 99))) for i in range(100)], "i int, y int")
    out = o.tail_split(df, ["i"], "y", least=3).collect()
    assert sorted(r.i for r in out if r.is_validation) == list(range(88, 100)) and all(r.row_no == r.i for r in out)


def test_relationship_and_membership_files(spark, tmp_path):
    (tmp_path / "rel.txt").write_text("# inferred clique: 1 2\n# IXP ASes: 9\n# source: x\n1|2|0|bgp\n1|3|-1\nbad|4|0\n3|4|7\n\n")
    relations, meta = files.read_relationships(spark, str(tmp_path / "rel.txt"))
    assert {tuple(r) for r in relations.collect()} == {(1, 2, 0), (2, 1, 0), (1, 3, -1), (3, 1, 1)}
    assert {tuple(r) for r in meta.collect()} == {("clique", 1), ("clique", 2), ("ixp", 9)}
    (tmp_path / "m.json").write_text(json.dumps({"netixlan": {"data": [{"asn": 1, "ix_id": 5}, {"asn": 1, "ix_id": 5}, {"asn": None, "ix_id": 2}]}}))
    assert [tuple(r) for r in files.read_memberships(spark, str(tmp_path / "m.json")).collect()] == [(1, 5)]


def test_side_file_picks(spark):
    fs = spark.createDataFrame([("a", dt.date(2025, 6, 1)), ("b", dt.date(2025, 7, 1))], "path string, file_date date")
    days = spark.createDataFrame([(dt.date(2025, 6, 12),), (dt.date(2025, 7, 20),), (dt.date(2025, 8, 3),), (dt.date(2025, 5, 1),)], "date date")
    pick = lambda f: {r.date.isoformat(): r.path for r in f(fs, days).collect()}
    assert pick(files.nearest_file) == {"2025-06-12": "a", "2025-07-20": "b", "2025-08-03": "b", "2025-05-01": "a"}
    assert pick(files.month_file) == {"2025-06-12": "a", "2025-07-20": "b", "2025-08-03": "b", "2025-05-01": None}
    assert pick(files.newest_file) == {"2025-06-12": "a", "2025-07-20": "b", "2025-08-03": None, "2025-05-01": None}


def test_snapshots_are_resumable(spark, tmp_path):
    edges = spark.createDataFrame([("p", "s1", 1, 2), ("p", "s2", 1, 3)], "pair string, stamp string, u int, v int")
    files.write_snapshots(edges, str(tmp_path / "s"))
    files.write_snapshots(edges.filter("stamp = 's2'").withColumn("v", F.lit(9)), str(tmp_path / "s"))
    assert sorted((r.stamp, r.v) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("s1", 2), ("s2", 9)]
    wanted = spark.createDataFrame([("p", "s1"), ("p", "s3")], "pair string, stamp string")
    assert [r.stamp for r in files.missing_snapshots(wanted, str(tmp_path / "s"), spark).collect()] == ["s3"]


def test_typed_edges_and_cosines(spark):
    e = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 1, 3)], "g string, u long, v long")
    rel = rl.both_directions(spark.createDataFrame([(1, 2, 0), (3, 2, -1)], "as1 long, as2 long, rel int"))
    assert {tuple(r)[1:] for r in rl.typed_edges(e, ["g"], rel).collect()} == {(1, 2, "p2p"), (2, 1, "p2p"), (3, 2, "p2c"), (2, 3, "c2p"), (1, 3, "unknown"), (3, 1, "unknown")}
    m = spark.createDataFrame([(1, 7), (2, 7)], "asn long, ix_id long")
    got = {(r.u, r.v): r.ixp_cosine_dist for r in rl.edge_cosine(e, ["g"], m).collect()}
    assert got == pytest.approx({(1, 2): 0.0, (2, 3): 0.0, (1, 3): 0.0}, abs=1e-9)
    none = {r.ixp_cosine_dist for r in rl.edge_cosine(e, ["g"], m.limit(0)).collect()}
    assert none == {-1.0}


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("  Hello, World! ",), ("1e400",), ("nan",), ("x",), (None,), ("2.5",)], "t string")
    assert [r[0] for r in df.select(files.finite(F.col("t"))).collect()] == [None, None, None, None, None, 2.5]
    assert df.select(files.slug(F.col("t"))).first()[0] == "hello_world"
