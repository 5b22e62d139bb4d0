"""Whole chains: detectors to labels, folds to calibrated and fused scores, alignment to deployment, aligned views."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import alignment as al
from pathloom.operators import chains as ch
from pathloom.operators import evaluation as ev
from pathloom.operators import labelling as lb
from pathloom.operators import models as mo
from pathloom.operators import statview as sv
from pathloom.operators import topology as topo
from pathloom.plans import graph_ops as go
from pathloom.plans import label_ops as lo
from pathloom.plans import stream_ops as so
from pathloom.plans.model_ops import _training
from pathloom.session import cut, ensure_checkpoint_dir
from pathloom.sources.segments import resume_windows
from pathloom.sources.updates import read_updates

COLUMNS = lo.COLUMNS


def labelling_chain(spark: SparkSession, d: str) -> DataFrame:
    """From raw windows to labels: scaling, components, five detectors, their vote, and the upgrade of rare clusters."""
    return ch.label_windows(lo._numeric(spark, d).select("row_id", "domain", *COLUMNS[:3]), "domain", "row_id", COLUMNS[:3])


def labelling_churn(spark: SparkSession, d: str) -> DataFrame:
    """How far the chain's labels differ from those discovered before."""
    pairs = labelling_chain(spark, d).join(lo._numeric(spark, d).select("row_id", "discovered_label"), "row_id")
    return lb.label_churn(pairs, "discovered_label", "label")


def principal_components(spark: SparkSession, d: str) -> DataFrame:
    """Share of variance of each component and the numbers needed for 90, 95 and 99 % (a scree table)."""
    return ch.scree(lb.robust_scale(lo._numeric(spark, d).select("row_id", *COLUMNS), COLUMNS), COLUMNS)


def _views(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold scores of a model of the statistical view and one of the graph view, with the row's domain and event."""
    rows = cut(_training(spark, d))
    stat = mo.out_of_fold(rows, COLUMNS[:2], "row_id", "logistic", 3).select("row_id", "y", F.col("score").alias("p_stat"))
    graph = mo.out_of_fold(rows, COLUMNS[2:], "row_id", "logistic", 3).select("row_id", F.col("score").alias("p_graph"))
    facts = lo._scored(spark, d).select("row_id", "domain", "event")
    return cut(stat.join(graph, "row_id").join(facts, "row_id"))


def fused_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of two views from folds that did not see the row: calibrated, stacked (by folds again), averaged."""
    rows = _views(spark, d)
    iso = mo.cross_fitted(rows, "row_id", lambda train, test: mo.calibrate_isotonic(train, test, "p_stat", "y").select("row_id", F.col("calibrated").alias("isotonic")))
    platt = mo.cross_fitted(rows, "row_id", lambda train, test: mo.calibrate_platt(train, test, "p_stat", "y").select("row_id", F.col("calibrated").alias("platt")))
    stacked = mo.cross_fitted(rows, "row_id", lambda train, test: mo.stack(train, test, ["p_graph", "p_stat"], ["row_id"]))
    return rows.join(iso, "row_id").join(platt, "row_id").join(stacked, "row_id").withColumn("mean", (F.col("p_graph") + F.col("p_stat")) / 2)


def fused_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Brier score, calibration error, average precision and best macro-F1 of each kind of score."""
    rows = cut(fused_scores(spark, d))
    kinds = ("p_stat", "p_graph", "isotonic", "platt", "fused", "mean")
    long = rows.select("domain", F.col("y").cast("int").alias("y"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in kinds])).alias("s")).select("domain", "y", "s.kind", "s.score")
    parts = [f(long, ["kind"], "y", "score") for f in (ev.brier, ev.calibration_error, ev.average_precision, ev.best_threshold)]
    return parts[0].join(parts[1], "kind").join(parts[2], "kind").join(parts[3], "kind")


def view_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Whether the two views differ in how sure they are: Wilcoxon's test for each domain and over all, with a correction
    for the number of tests (Holm)."""
    rows = _views(spark, d)
    return ch.test_suite(rows, "domain", "p_stat", "p_graph")


def seed_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread of a window's scores over models of five seeds, each from folds that did not see it."""
    rows = cut(_training(spark, d))
    parts = [mo.out_of_fold(rows, COLUMNS, "row_id", "rf", 3, seed=s, numTrees=20, maxDepth=5).select("row_id", F.lit(s).alias("seed"), "score") for s in range(5)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return ch.ensemble(every, ["row_id"], "score")


def labelled_source(spark: SparkSession, d: str) -> DataFrame:
    """Normal and anomalous windows of all domains as one training table: y is 0 or 1, uncertain ones are left out."""
    rows = lo._numeric(spark, d)
    return ch.labelled_source(rows.filter("discovered_label = 'likely_normal'"), rows.filter("discovered_label in ('likely_anomalous', 'highly_anomalous')")).select("row_id", "domain", "y", *COLUMNS)


def pseudo_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Every domain's windows aligned class by class to the next one's, whose classes are guessed from its scores."""
    rows = lo._numeric(spark, d).filter("binary is not null").select("row_id", "domain", F.col("binary").cast("int").alias("y"), *COLUMNS[:3], F.col("consensus_score").alias("score"))
    names = sorted(r[0] for r in rows.select("domain").distinct().collect())  # a row a domain
    out = [ch.class_aligned(rows.filter(F.col("domain") == a), rows.filter(F.col("domain") == b), COLUMNS[:3], "y", "score").withColumn("target", F.lit(b)) for a, b in zip(names, names[1:] + names[:1], strict=True) if a != b]
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every.select("row_id", F.col("domain").alias("source"), "target", "aligned_class", *COLUMNS[:3])


def deployed(spark: SparkSession, d: str) -> DataFrame:
    """Scores of each domain's windows under a model of all other domains' windows moved to it (filled, standardised, aligned)."""
    from pathloom.plans.series_ops import labelled

    # deployed rows may have gaps, which are filled; each domain reads all rows many times, so copies are dropped once
    rows = cut(labelled(spark, d).select("row_id", "domain", F.col("binary").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in COLUMNS[:3]]))
    names = sorted(r[0] for r in rows.select("domain").distinct().collect())  # a row a domain
    one = lambda n: ch.deploy(rows.filter((F.col("domain") != n) & F.col("y").isNotNull()), rows.filter(F.col("domain") == n), COLUMNS[:3], ["row_id", "domain"])
    with ThreadPoolExecutor(4) as pool:  # the fits are many short jobs, which leave most cores idle
        parts = list(pool.map(one, names))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def ensemble_shap(spark: SparkSession, d: str) -> DataFrame:
    """Sampled SHAP values of a linear ensemble's scores for the anomalous windows, against a class-stratified background."""
    rows = cut(_training(spark, d))
    models = [mo.fit(rows, COLUMNS, "logistic", regParam=reg) for reg in (0.0, 0.01, 0.1)]
    weights = [(np.array(m.stages[2].coefficients.toArray()), float(m.stages[2].intercept), np.array(m.stages[1].mean.toArray()), np.array(m.stages[1].std.toArray())) for m in models]

    def predict(x: np.ndarray) -> np.ndarray:
        return np.mean([1 / (1 + np.exp(-(((x - mean) / np.where(sd > 0, sd, 1)) @ w + b))) for w, b, mean, sd in weights], axis=0)

    background = ch.stratified_background(rows, "y", "row_id", COLUMNS, 100)
    return mo.sampled_shap(predict, background, rows.filter("y = 1"), COLUMNS, ["row_id"])


def aligned_windows(spark: SparkSession, d: str) -> DataFrame:
    """One row for each window with updates: the topology at its end, the target's place in it, and the statistical view."""
    log = topo.with_segment(read_updates(spark, d))  # not kept: its readers share one scan and one shuffle
    both = cut(topo.window_topology(log, go.GROUP, so.TARGET))  # a row a window
    place = ["target_degree", "target_references"]
    return sv.align_views(both.drop(*place), both.select(*so.KEYS, *place).filter("target_degree is not null"), sv.stat_view(log, so.KEYS), so.KEYS)


def resumed_windows(spark: SparkSession, d: str) -> DataFrame:
    """The statistical view written segment by segment, in two runs of which the second takes up what the first left."""
    log = cut(topo.with_segment(read_updates(spark, d)))
    where = f"{ensure_checkpoint_dir(spark)}/segments-{uuid.uuid4().hex}"
    middle = log.agg(F.timestamp_micros(((F.unix_micros(F.min("segment")) + F.unix_micros(F.max("segment"))) / 2).cast("bigint"))).first()[0]
    resume_windows(log.filter(F.col("segment") <= F.lit(middle)), where)
    return resume_windows(log, where).drop("part")


QUERIES = {
    f.__name__: f
    for f in (
        labelling_chain, labelling_churn, principal_components, fused_scores, fused_metrics, view_comparison, seed_ensemble, labelled_source, pseudo_aligned, deployed, ensemble_shap, aligned_windows, resumed_windows,
    )
}

_VIEW_COLUMNS = f"{so._VOLUME}, unique_peers, " + ", ".join(f"coalesce({c.strip()}, 0) AS {c.strip()}" for cols in so._REST.values() for c in cols.split(","))
_VIEW_JOINS = " ".join(f"LEFT JOIN {t} USING (collector, w)" for t in so._REST)
_LIVE_REST = go._LIVE.split(so.UPDATES_SQL, 1)[1].strip().removeprefix(",").rstrip().replace("wins", "live_windows")

ORACLE = {
    "labelled_source": lo._N + " SELECT row_id, domain, CASE WHEN discovered_label = 'likely_normal' THEN 0 ELSE 1 END AS y, announcements, as_path_avg, n_nodes, consensus_score FROM n WHERE discovered_label IN ('likely_normal', 'likely_anomalous', 'highly_anomalous')",
    "resumed_windows": so._VIEW + f"SELECT collector, w, {_VIEW_COLUMNS} FROM vol3 {_VIEW_JOINS}",
    "aligned_windows": f"{so._VIEW.rstrip()}, {_LIVE_REST}" + f""", nn AS (SELECT collector, w, count(DISTINCT x) AS n_nodes FROM (SELECT collector, w, unnest([u, v]) AS x FROM live) GROUP BY ALL),
gv AS (SELECT l.collector, l.w, count(*) AS n_edges, sum(refs)::BIGINT AS "references", any_value(n_nodes) AS n_nodes FROM live l JOIN nn USING (collector, w) GROUP BY ALL),
nv AS (SELECT collector, w, count(*) AS target_degree, sum(refs)::BIGINT AS target_references FROM live WHERE {so.TARGET} IN (u, v) GROUP BY ALL),
st AS (SELECT collector, w, {_VIEW_COLUMNS} FROM vol3 {_VIEW_JOINS}) SELECT * FROM gv LEFT JOIN nv USING (collector, w) LEFT JOIN st USING (collector, w)""",
}
