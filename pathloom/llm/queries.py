"""Queries p1, p2, p4, p8, p9 and p10, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.net import address, network
from pathloom.functions.paths import clean_path
from pathloom.llm.heavy_items import frequent_items, heavy_items
from pathloom.llm.mixing import mix
from pathloom.llm.packing import pack, packing_report
from pathloom.llm.runs import collapse_runs, run_members
from pathloom.llm.sentences import sentences
from pathloom.llm.splits import split_together
from pathloom.llm.tokens import with_tokens
from pathloom.operators.grid import floor_time, window_id
from pathloom.session import cut, table


def event_name(text: Column) -> Column:
    return F.nullif(F.translate(F.lower(F.btrim(text)), "-", "_"), F.lit(""))


def splits(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled window (copies once) with its split."""
    shares = {r.split_name: r.share for r in table(spark, d, "split_targets").collect()}  # a row a split
    rows = table(spark, d, "labelled_windows").select("row_id", "window_start", "window_id", "event_id").distinct()
    start = F.col("window_start").cast("timestamp")
    own = F.nullif(F.btrim("window_id"), F.lit(""))
    rows = rows.select("row_id", event_name(F.col("event_id")).alias("event"), F.coalesce(window_id(floor_time(start, 300)), own).alias("window"))
    return split_together(rows, "row_id", "event", "window", shares)


def split_report(spark: SparkSession, d: str) -> DataFrame:
    rows = splits(spark, d).groupBy("split_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event").alias("n_events"))
    total = rows.agg(F.sum("n_rows").alias("all_rows"))  # one row
    report = rows.crossJoin(F.broadcast(total)).withColumn("reached", F.col("n_rows") / F.col("all_rows"))
    return table(spark, d, "split_targets").join(report, "split_name", "left").select("split_name", "share", "reached", "n_rows", "n_events")


def unsplit(spark: SparkSession, d: str) -> DataFrame:
    """Of every event and every window, how many splits its rows are in."""
    rows = splits(spark, d)
    both = rows.select(F.explode(F.array(F.struct(F.lit("event").alias("kind"), F.col("event").alias("name")), F.struct(F.lit("window").alias("kind"), F.col("window").alias("name")))).alias("x"), "split_name")
    return both.filter("x.name is not null").groupBy("x.kind", "x.name").agg(F.count_distinct("split_name").alias("n_splits"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of events of one component, which is what makes them share a split."""
    events = splits(spark, d).filter("event is not null").select("event", "component", "split_name").distinct()
    a, b = events.select(F.col("event").alias("event_a"), "component", "split_name"), events.select(F.col("event").alias("event_b"), "component", "split_name")
    return a.join(b, ["component", "split_name"]).filter("event_a < event_b").select("event_a", "event_b")


def _run_spec(spark: SparkSession, d: str) -> dict:
    rows = table(spark, d, "updates").select("seq", "timestamp", "type", "peer_ip", "prefix", "as_path", "origin")
    kind = F.upper(F.btrim("type"))
    announced = lambda c: F.when(kind == "A", c)
    rows = rows.filter(F.length(F.btrim("prefix")) > 0)
    return {
        "events": rows,
        "keys": {"peer_ip": address(F.col("peer_ip")), "prefix": network(F.col("prefix"))},
        "time": F.col("timestamp").cast("timestamp"),
        "order": F.col("seq"),
        "same": [
            kind.alias("type"),
            announced(clean_path(F.col("as_path"))).alias("as_path"),
            announced(F.lower(F.btrim(F.coalesce("origin", F.lit(""))))).alias("origin"),
        ],
    }


def runs(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(**_run_spec(spark, d)).select("peer_ip", "prefix", "event.*", "first_ts", "last_ts", "events", "duration_s", "first_order")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return run_members(**_run_spec(spark, d)).select(F.col("first_order").alias("first_seq"), F.col("member_order").alias("repeat_seq"))


def _item_spec(spark: SparkSession, d: str) -> dict:
    rows = table(spark, d, "updates").select("seq", "type", "prefix", "as_path")
    path = F.when(F.upper(F.btrim("type")) == "A", F.nullif(clean_path(F.col("as_path")), F.lit("")))
    return {"rows": rows, "fields": {"prefix": network(F.col("prefix")), "as_path": path}, "record": F.col("seq")}


def top_items(spark: SparkSession, d: str) -> DataFrame:
    return heavy_items(**_item_spec(spark, d), k=100)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent_items(**_item_spec(spark, d), share=0.005).select("field", "item")


CAPACITY = 2048


def _token_counts(spark: SparkSession, d: str) -> DataFrame:
    return with_tokens(table(spark, d, "documents").select("doc_id", "source", "text"), "text").select("doc_id", "source", "tokens")


def containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(_token_counts(spark, d), "doc_id", "tokens", CAPACITY)


def container_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(containers(spark, d), CAPACITY)


def packed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Of every document, whether its pieces follow on each other without gap and only large ones have several; and of
    every container whether it is within its capacity (as the documents in it)."""
    pieces = cut(containers(spark, d))
    room = pieces.filter("container_id is not null").groupBy("container_id").agg(F.sum("piece_size").alias("used"))
    full = pieces.join(room, "container_id", "left").withColumn("fits", F.coalesce(F.col("used") <= CAPACITY, F.lit(True)))
    size, reach = F.sum("piece_size"), F.max(F.col("piece_start") + F.col("piece_size"))
    whole = (size == reach) & ((F.count(F.lit(1)) == 1) | (size > CAPACITY)) & (F.count(F.lit(1)) == F.greatest(F.max("pieces"), F.lit(1)))
    return full.groupBy("doc_id").agg(whole.alias("whole"), F.every("fits").alias("fits"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return containers(spark, d).filter("pieces > 1 and piece_no = 0").select("doc_id")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts = cut(_token_counts(spark, d))  # read in every round, so tokens are counted once
    return mix(counts, "doc_id", "source", "tokens", table(spark, d, "mix_targets"))


def mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def mix_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def mixed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Of every document, whether its copies are a whole number next to its rate and within its source's cap."""
    caps = table(spark, d, "mix_targets").select(F.lower(F.btrim("source")).alias("source"), F.col("max_repeats").alias("cap"))
    rows = mixture(spark, d).join(caps, "source", "left")
    held = (F.abs(F.col("copies") - F.col("rate")) < 1 + 1e-6) & (F.col("copies") >= 0) & (F.col("copies") <= F.coalesce("cap", F.lit(0)))
    return rows.select("doc_id", held.alias("held"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(spark, d).filter("not reachable").select("source")


def all_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return all_sentences(spark, d).select("doc_id", "start_pos", "end_pos")


QUERIES = {
    "p1_splits": splits,
    "p1_split_report": split_report,
    "p1_unsplit": unsplit,
    "p1_found": p1_found,
    "p2_runs": runs,
    "p2_found": p2_found,
    "p4_top_items": top_items,
    "p4_found": p4_found,
    "p8_containers": containers,
    "p8_report": container_report,
    "p8_packed_documents": packed_documents,
    "p8_found": p8_found,
    "p9_mixture": mixture,
    "p9_mix_report": mix_report,
    "p9_mixed_documents": mixed_documents,
    "p9_found": p9_found,
    "p10_sentences": all_sentences,
    "p10_found": p10_found,
}

ORACLE: dict[str, str] = {
    "p1_found": """
WITH RECURSIVE base AS (
  SELECT nullif(replace(lower(trim(event_id)), '-', '_'), '') AS e,
         coalesce(strftime(time_bucket(INTERVAL 5 minutes, window_start), '%Y%m%d_%H%M'), nullif(trim(window_id), '')) AS w
  FROM labelled_windows),
pairs AS (SELECT DISTINCT e, w FROM base WHERE e IS NOT NULL AND w IS NOT NULL),
near AS (SELECT DISTINCT a.e AS a, b.e AS b FROM pairs a JOIN pairs b ON a.w = b.w),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
SELECT a AS event_a, b AS event_b FROM reach WHERE a < b""",
    "p1_unsplit": """WITH base AS (
  SELECT nullif(replace(lower(trim(event_id)), '-', '_'), '') AS e, coalesce(strftime(time_bucket(INTERVAL 5 minutes, window_start), '%Y%m%d_%H%M'), nullif(trim(window_id), '')) AS w FROM labelled_windows)
SELECT DISTINCT 'event' AS kind, e AS name, 1::BIGINT AS n_splits FROM base WHERE e IS NOT NULL UNION ALL SELECT DISTINCT 'window', w, 1 FROM base WHERE w IS NOT NULL""",
    "p8_packed_documents": "SELECT doc_id, true AS whole, true AS fits FROM documents",
    "p9_mixed_documents": "SELECT doc_id, true AS held FROM documents",
}
