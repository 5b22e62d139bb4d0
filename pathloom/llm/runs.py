"""Runs of repeated consecutive events, each collapsed into one event with its count and duration."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.chunked import merge_edge_runs
from pathloom.operators.grid import MICRO

_PIECE = ["_start", "_sig", "_from", "_to", "_n", "_least"]


def _marked(events: DataFrame, keys: Mapping[str, Column], time: Column, order: Column, same: list[Column], max_gap_seconds: int, chunk_seconds: int) -> DataFrame:
    """Each event (copies once) with its position, whether it differs from its predecessor, and the position of
    the last event up to it that does. Positions, predecessors and runs are those within (key, chunk)."""
    rows = events.select(*[c.alias(k) for k, c in keys.items()], time.alias("_t"), order.alias("_o"), F.struct(*same).alias("_sig"))
    rows = rows.filter("_t is not null")
    rows = rows.withColumn("_chunk", F.floor(F.unix_micros("_t") / F.lit(chunk_seconds * MICRO)).cast("bigint"))
    part = [*keys, "_chunk"]
    w = Window.partitionBy(*part).orderBy("_t", "_o")
    # a copy repeats time and order exactly, so it follows its original
    rows = rows.repartition(*part).withColumn("_copy", (F.lag("_o").over(w) == F.col("_o")) & (F.lag("_t").over(w) == F.col("_t")))
    rows = rows.filter(~F.coalesce("_copy", F.lit(False))).drop("_copy")
    rows = rows.withColumns({"_pos": F.row_number().over(w), "_before": F.lag(F.struct("_t", "_sig")).over(w)})
    near = F.unix_micros("_t") - F.unix_micros("_before._t") <= F.lit(max_gap_seconds * MICRO)
    rows = rows.withColumn("_differs", ~F.coalesce(F.col("_before._sig").eqNullSafe(F.col("_sig")) & near, F.lit(False)))
    return rows.withColumn("_start", F.max(F.when(F.col("_differs"), F.col("_pos"))).over(w))


def _at_border(max_gap_seconds: int, chunk_seconds: int) -> Column:
    """Whether a piece may go on in a neighbouring chunk: it lies within the largest gap of the border."""
    begin = F.col("_chunk") * F.lit(chunk_seconds * MICRO)
    first = (F.col("_start") == 1) & (F.unix_micros("_from") - begin <= F.lit(max_gap_seconds * MICRO))
    last = (F.col("_start") + F.col("_n") - 1 == F.col("_size")) & (begin + F.lit(chunk_seconds * MICRO) - F.unix_micros("_to") <= F.lit(max_gap_seconds * MICRO))
    return first | last


def _stitched(pieces: DataFrame, keys: list[str], max_gap_seconds: int) -> DataFrame:
    """Border pieces with the whole run's first and last time, count, smallest order and root piece."""
    piece = F.struct(*_PIECE)
    edges = pieces.groupBy(*keys, F.col("_chunk").alias("chunk")).agg(
        F.max(F.when(F.col("_start") == 1, piece)).alias("first"),
        F.max(F.when(F.col("_start") + F.col("_n") - 1 == F.col("_size"), piece)).alias("last"),
    )
    # a chunk holds one run if its first piece is its last
    edges = edges.withColumn("runs", F.when(F.col("first._start") == F.col("last._start"), 1).otherwise(2))

    def joins(last: Column, first: Column) -> Column:
        gap = F.unix_micros(first["_from"]) - F.unix_micros(last["_to"])
        return last["_sig"].eqNullSafe(first["_sig"]) & (gap <= F.lit(max_gap_seconds * MICRO))

    rooted = merge_edge_runs(edges, keys, joins)
    went_on = F.when(F.col("root").isNotNull(), F.struct("root", F.col("first").alias("p")))
    own = F.col("last").isNotNull() & ((F.col("runs") > 1) | F.col("root").isNull())
    began = F.when(own, F.struct(F.col("chunk").alias("root"), F.col("last").alias("p")))
    # the first piece of a chunk that neither goes on nor is its last stands alone
    alone = F.when(F.col("first").isNotNull() & F.col("root").isNull() & (F.col("runs") > 1), F.struct((-F.col("chunk") - 1).alias("root"), F.col("first").alias("p")))
    parts = rooted.select(*keys, F.col("chunk").alias("_chunk"), F.explode(F.array_compact(F.array(went_on, began, alone))).alias("e"))
    parts = parts.select(*keys, "_chunk", F.col("e.root").alias("_root"), *[F.col(f"e.p.{c}").alias(c) for c in _PIECE])
    whole = Window.partitionBy(*keys, "_root")
    first = F.min(F.struct("_chunk", "_start", "_from")).over(whole)
    return parts.select(
        *keys, "_chunk", "_start", "_sig",
        ((first["_chunk"] == F.col("_chunk")) & (first["_start"] == F.col("_start"))).alias("_head"),
        F.min("_from").over(whole).alias("_from"), F.max("_to").over(whole).alias("_to"),
        F.sum("_n").over(whole).alias("_n"), F.min("_least").over(whole).alias("_least"),
    )


def _starts(rows: DataFrame, keys: list[str], max_gap_seconds: int, chunk_seconds: int) -> tuple[DataFrame, DataFrame]:
    """The runs of marked rows, from the rows that differ from their predecessor alone: a lead over these
    starts gives the next start, the difference of positions the count, the time before it the end.

    Two tables of _PIECE columns with the place (keys, _chunk, _start) of each start: runs within a chunk, and
    the pieces of runs that may cross a border with what is known of the whole run (`_head`: its first piece).
    """
    part = [*keys, "_chunk"]
    w = Window.partitionBy(*part).orderBy("_t", "_o")
    whole = Window.partitionBy(*part)
    so_far = F.min("_o").over(Window.partitionBy(*part, "_start").orderBy("_pos"))  # of the run up to this event
    rows = rows.withColumn("_so_far", so_far).withColumns(
        {"_end_before": F.lag(F.struct("_t", "_so_far")).over(w), "_size": F.count(F.lit(1)).over(whole), "_end": F.max(F.struct("_pos", "_t", "_so_far")).over(whole)}
    )
    starts = rows.filter("_differs")
    next_end = F.lead("_end_before").over(w)
    pieces = starts.select(
        *part, "_start", "_sig", F.col("_t").alias("_from"), "_size",
        (F.coalesce(F.lead("_pos").over(w), F.col("_size") + 1) - F.col("_pos")).alias("_n"),
        F.coalesce(next_end["_t"], F.col("_end._t")).alias("_to"),
        F.coalesce(next_end["_so_far"], F.col("_end._so_far")).alias("_least"),
    )
    border = _at_border(max_gap_seconds, chunk_seconds)
    return pieces.filter(~border), _stitched(pieces.filter(border), keys, max_gap_seconds)


def collapse_runs(
    events: DataFrame, keys: Mapping[str, Column], time: Column, order: Column, same: list[Column],
    max_gap_seconds: int = 900, chunk_seconds: int = 21_600,
) -> DataFrame:
    """One row for each run: keys, `event` (what the run says), `first_ts`, `last_ts`, `events`,
    `duration_s` and `first_order` (the smallest order value of the run).

    A run is a maximal series of successive events of a key, by (time, order), whose `same` columns are
    equal (null equals null), each at most max_gap_seconds after the one before. Only the rows that differ
    from their predecessor are kept; a lead over these starts gives the next start: the difference of the
    positions is the count, the time before the next start is the run's end.

    Events without time are left out; null key parts are keys like any other; copies (equal time and
    order) count once; an empty table gives no runs.

    Windows are over (key, time chunk), so a key that holds a third of all rows is spread over its chunks.
    A run can cross a border only within max_gap_seconds of it: just those pieces are stitched.
    """
    rows = _marked(events, keys, time, order, same, max_gap_seconds, chunk_seconds)
    inner, across = _starts(rows, list(keys), max_gap_seconds, chunk_seconds)
    columns = [*keys, "_sig", "_from", "_to", "_n", "_least"]
    runs = inner.select(*columns).unionByName(across.filter("_head").select(*columns))
    return runs.select(
        *keys, F.col("_sig").alias("event"), F.col("_from").alias("first_ts"), F.col("_to").alias("last_ts"), F.col("_n").cast("bigint").alias("events"),
        ((F.unix_micros("_to") - F.unix_micros("_from")) / MICRO).alias("duration_s"), F.col("_least").alias("first_order"),
    )


def run_members(
    events: DataFrame, keys: Mapping[str, Column], time: Column, order: Column, same: list[Column],
    max_gap_seconds: int = 900, chunk_seconds: int = 21_600,
) -> DataFrame:
    """For each event of a run of two or more but its smallest: `first_order` and `member_order`.

    The runs are those of collapse_runs, found from the starts alone; an event joins its run by position: by
    (key, chunk, last start at or before it). Runs of one event have no members and do not reach the join, nor do
    their events, but for the few at a chunk's border. A join's hash is by start, so a hot key is spread.
    """
    rows = _marked(events, keys, time, order, same, max_gap_seconds, chunk_seconds)
    inner, across = _starts(rows, list(keys), max_gap_seconds, chunk_seconds)
    place = [*keys, "_chunk", "_start"]
    runs = inner.select(*place, "_n", "_least").unionByName(across.select(*place, "_n", "_least")).filter("_n > 1")
    runs = runs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(place)], F.col("_least").alias("first_order"))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_t", "_o")
    # a start that is followed by a start is a run of its own, unless the run goes on in the next chunk
    ends = rows.withColumn("_lonely", F.col("_differs") & F.lead("_differs").over(w))
    begin = F.col("_chunk") * F.lit(chunk_seconds * MICRO)
    inside = (F.unix_micros("_t") - begin > F.lit(max_gap_seconds * MICRO)) & (begin + F.lit(chunk_seconds * MICRO) - F.unix_micros("_t") > F.lit(max_gap_seconds * MICRO))
    several = ends.filter(~(F.coalesce("_lonely", F.lit(False)) & inside)).select(*place, F.col("_o").alias("member_order"))
    on = reduce(and_, [several[k].eqNullSafe(runs[f"_k{i}"]) for i, k in enumerate(place)])
    return several.join(runs, on).filter("member_order <> first_order").select("first_order", "member_order")
