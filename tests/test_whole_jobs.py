"""Queries over the whole job: full windows, domains, pairs and rows."""

import datetime as dt
import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pathloom.operators import alignment as al
from pathloom.operators import detectors as de
from pathloom.plans.label_ops import COLUMNS as MEASURES
from pathloom.operators import relations as r
from pathloom.plans.label_ops import _numeric
from pathloom.plans.relation_ops import _paths
from pathloom.plans.stream_ops import TARGET
from pathloom.session import table
from tests.test_topology_stream import COLUMNS, T0, random_log, replay

MINUTE = dt.timedelta(minutes=1)


@pytest.fixture
def updates(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "updates.parquet"))
        return str(tmp_path)

    return write


def update(seq, minutes, kind, path, collector="c"):
    return (seq, T0 + minutes * MINUTE, collector, kind, "ip", "9", f"p{seq // 2}", "IGP", "nh", path)


def test_edges_of_less_than_an_hour_appear(spark, updates):
    d = updates([update(0, 1, "A", "11 12"), update(1, 12, "W", ""), update(2, 30, "A", "13 14")])
    churn = {r.w: (r.edges_added, r.edges_removed) for r in entry.queries()["edge_churn"](spark, d).collect()}
    assert churn == {T0: (1, 0), T0 + 10 * MINUTE: (0, 1), T0 + 30 * MINUTE: (1, 0)}
    live = {(r.w, r.u, r.v) for r in entry.queries()["live_edges_per_window"](spark, d).collect()}
    assert live == {(T0, 11, 12), (T0 + 30 * MINUTE, 13, 14)}
    assert {r.w for r in entry.queries()["topology_evolution"](spark, d).collect()} == {T0, T0 + 30 * MINUTE}


def test_five_minute_live_edges_equal_an_ordered_replay(spark, updates):
    rows = random_log()
    got = {(r.collector, int((r.w - dt.datetime(1970, 1, 1)).total_seconds()), r.u, r.v): r.refs for r in entry.queries()["live_edges_per_window"](spark, updates(rows)).collect()}
    assert got == replay(rows, 300)


def test_views_of_five_minutes(spark, updates):
    d = updates([update(0, 1, "A", "11 12"), update(1, 12, "W", ""), update(2, 13, "A", "13 14")])
    want = {T0: (1, 0), T0 + 10 * MINUTE: (1, 1)}
    for name in ("stat_view_full", "win_volume", "stream_window_counts"):
        assert {r.w: (r.announcements, r.withdrawals) for r in entry.queries()[name](spark, d).collect()} == want, name
    assert {r.w for r in entry.queries()["ego_filter_ratio"](spark, d).collect()} == set(want)


def test_detectors_score_against_the_whole_domain(spark, data, tmp_path):
    later = F.timestamp_micros(F.unix_micros(F.col("window_start").cast("timestamp")) + F.pmod("row_id", F.lit(9)) * 86_400_000_000)
    table(spark, data, "labelled_windows").withColumn("window_start", later).write.parquet(str(tmp_path / "labelled_windows.parquet"))
    got = entry.queries()["detectors"](spark, str(tmp_path)).toPandas().set_index("row_id")
    rows = _numeric(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows)
    for _, part in rows.groupby("domain"):
        x = part[MEASURES].to_numpy(dtype=float)
        q = np.percentile(x, [25, 50, 75], axis=0)
        z = (x - q[1]) / np.where(q[2] > q[0], q[2] - q[0], 1.0)
        mine = got.loc[part["row_id"]]
        assert part["w"].max() - part["w"].min() > dt.timedelta(days=4) and mine["neighbours"].nunique() == 1
        d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        assert mine["lof"].to_numpy() == pytest.approx(de.local_outlier_factor(d, int(mine["neighbours"].iloc[0])), rel=1e-6)


def test_detectors_take_large_groups(spark):
    rows = spark.range(20_100).selectExpr("id", "'g' AS g", "CASE WHEN id = 7 THEN 900.0 ELSE sin(id) END AS x", "CAST(id % 997 AS DOUBLE) AS y")
    got = de.detect(rows, "g", "id", ["x", "y"]).toPandas().set_index("id")
    assert len(got) == 20_100 and got["lof"].idxmax() == 7


def test_every_ordered_pair_of_domains(spark):
    from pathloom.plans.model_ops import FEATURES, _matrix

    d = "/root/testdata/sf0.01"
    q, rows = entry.queries(), _matrix(spark, d).cache()
    names = sorted(r[0] for r in rows.select("collector").distinct().collect())
    pairs = {(a, b) for a in names for b in names if a != b}
    assert len(names) == 4
    gaps = {(r.source, r.target): r.frobenius_gap for r in q["cov_gap"](spark, d).collect()}
    report = {(r.source, r.target, r.stage): r for r in q["alignment_report"](spark, d).collect()}
    coral, scaled = q["coral_transform"](spark, d).toPandas(), q["joint_standardize"](spark, d).toPandas()
    assert set(gaps) == pairs and {p[:2] for p in report} == pairs and len(report) == 24
    assert len(coral) == len(scaled) == 3 * rows.count()
    for a, b in ((names[1], names[2]), (names[3], names[0])):
        x, y = al.joint_standardize(rows.filter(F.col("collector") == a), rows.filter(F.col("collector") == b), FEATURES)
        moved = al.coral(x, y, FEATURES)
        assert gaps[a, b] == pytest.approx(al.covariance_gap(x, y, FEATURES).first()[0])
        for got, want in ((coral, moved), (scaled, x)):
            want = want.select("feature_id", *FEATURES).toPandas().set_index("feature_id").sort_index()
            got = got[(got["source"] == a) & (got["target"] == b)].set_index("feature_id").sort_index()
            assert got[FEATURES].to_numpy() == pytest.approx(want.to_numpy(), abs=1e-6)
        before, width = al.mmd_rbf(x, y, FEATURES, "feature_id")
        after, _ = al.mmd_rbf(moved, y, FEATURES, "feature_id", bandwidth=width)
        assert report[a, b, "before"].mmd2 == pytest.approx(before.first().mmd2, abs=1e-6)
        assert report[a, b, "after"].mmd2 == pytest.approx(after.first().mmd2, abs=1e-6)
        assert report[a, b, "after"].frobenius_gap == pytest.approx(al.covariance_gap(moved, y, FEATURES).first()[0], abs=1e-6)
    rows.unpersist()


def test_class_gaps_of_every_pair(spark):
    d = "/root/testdata/sf0.01"
    rows = _numeric(spark, d).filter("binary is not null")
    got = {(r.source, r.target, r["class"]): r.frobenius_gap for r in entry.queries()["class_cov_gap"](spark, d).collect()}
    assert len({k[:2] for k in got}) == 12
    a, b = sorted({k[0] for k in got})[1:3]
    want = al.class_gaps(rows.filter(F.col("domain") == a), rows.filter(F.col("domain") == b), MEASURES, "binary")
    for r in want.collect():
        assert got[a, b, r["class"]] == pytest.approx(r.frobenius_gap)


def test_ego_rates_are_of_the_targets_network(spark, updates):
    t = TARGET
    # neighbours of the target in c: 11 and 13; none of them is a multiple of 50, and 100, 200 and 300 are not in its network
    paths = [f"11 {t} 13", f"{t} 11 17", "13 19 23", "100 200 300", "29 31 37"]
    d = updates([update(2 * i, i, "A", p) for i, p in enumerate(paths)] + [update(20, 9, "A", "11 41 43", "e")])
    log, relations = _paths(spark, d)
    checks = {x.seq: x for x in r.path_checks(log.select("seq", "path"), relations).collect()}
    ego = [checks[s] for s in (0, 2, 4)]
    bad = [s for s in (0, 2, 4) if checks[s].known > 0 and not checks[s].valid]
    got = {x.collector: x for x in entry.queries()["ego_vf_rates"](spark, d).collect()}
    assert got["c"].ego_paths_total == 3 and got["c"].paths_total == 5
    assert got["c"].ego_paths_checked == sum(x.known > 0 for x in ego)
    assert (got["c"].ego_transit_violations, got["c"].ego_origin_violations) == (sum(s == 0 for s in bad), sum(s == 2 for s in bad))
    assert got["e"].ego_paths_total is None


def test_a_period_of_half_an_hour_is_found(spark, data, tmp_path):
    """One series with a burst every six windows, which hourly means cannot show."""
    kinds = dict(table(spark, data, "window_features").dtypes)
    given = {"feature_id": "id", "collector": "'c'", "asn": "1", "total_updates": "IF(id % 6 = 0, 90, 10)", "window_start": "timestamp_seconds(1751328000 + 300 * id)"}
    rows = spark.range(900).selectExpr(*[f"CAST({given.get(c, 'NULL')} AS {k}) AS {c}" for c, k in kinds.items()])
    rows.write.parquet(str(tmp_path / "window_features.parquet"))
    found = entry.queries()["dominant_period"](spark, str(tmp_path)).collect()
    assert [x.period for x in found] == [6]
    lags = [x.lag for x in entry.queries()["acf_lags"](spark, str(tmp_path)).collect()]
    assert sorted(lags) == list(range(4, 301))


def test_models_run_at_full_size(spark, data, monkeypatch):
    from pathloom.operators import labelling as lb
    from pathloom.operators import models as mo

    seen = {}

    def spy(module, name):
        real = getattr(module, name)
        signature = inspect.signature(real)

        def run(*args, **more):
            given = signature.bind(*args, **more)
            given.apply_defaults()
            seen[name, given.arguments.get("name")] = given.arguments
            return real(*args, **more)

        monkeypatch.setattr(module, name, run)

    for module, name in ((mo, "fit"), (mo, "kmeans_upgrade"), (de, "isolation_forest"), (lb, "subsample_stability")):
        spy(module, name)
    for query in ("isolation_forest", "subsample_stability", "kmeans_upgrade", "gbt_scores", "rf_scores", "mlp_scores"):
        entry.queries()[query](spark, data)
    assert list(seen["kmeans_upgrade", None]["tries"]) == list(range(2, 11))
    assert seen["isolation_forest", None]["trees"] == 200 and seen["subsample_stability", None]["rounds"] == 20
    for model in ("gbt", "rf", "mlp"):
        assert seen["fit", model]["settings"] == {} and len(seen["fit", model]["columns"]) == 4
    assert len(seen["isolation_forest", None]["columns"]) == 4


def test_aligned_windows_lists_no_edge_by_window_and_keeps_no_log(spark, data, monkeypatch):
    from pathloom.operators import topology as topo
    from pathloom.plans import chain_ops as co
    from pathloom.plans import graph_ops as go
    from pathloom.plans import stream_ops as so
    from pathloom.sources.updates import read_updates

    log = topo.with_segment(read_updates(spark, data))
    live = topo.live_edges(log, go.GROUP)
    target = live.groupBy("u").count().orderBy(F.desc("count"), "u").first().u
    near = live.filter((F.col("u") == target) | (F.col("v") == target)).groupBy(*so.KEYS).agg(F.count(F.lit(1)).alias("d"), F.sum("refs").alias("r"))
    wanted = topo.topology_evolution(live, go.GROUP).join(near, so.KEYS, "left")
    columns = [*so.KEYS, "n_edges", "references", "n_nodes"]
    got = topo.window_topology(log, go.GROUP, target).select(*columns, "target_degree", "target_references")
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in wanted.select(*columns, F.col("d").alias("target_degree"), F.col("r").alias("target_references")).collect())
    kept = []
    monkeypatch.setattr(topo, "live_edges", lambda *a, **k: pytest.fail("edges listed by window"))
    monkeypatch.setattr(co, "cut", lambda df: kept.append(df.columns) or df)
    co.aligned_windows(spark, data)
    assert not any("path" in c for c in kept)
