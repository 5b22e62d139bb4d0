"""The topology as deltas against an ordered replay, and streams against batches."""

import datetime as dt
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pathloom.operators import statview as sv
from pathloom.operators import topology as topo
from pathloom.session import table
from pathloom.sources.updates import update_log
from pathloom.streaming import topology as stream

T0 = dt.datetime(2025, 7, 1)
COLUMNS = "seq long, timestamp timestamp, collector string, type string, peer_ip string, peer_as string, prefix string, origin string, next_hop string, as_path string"


def edges_of(path):
    hops = [int(x) for x in path.split()]
    return {(min(a, b), max(a, b)) for a, b in zip(hops, hops[1:]) if a != b}


def random_log(n=1500, seed=9):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice("AAAW")
        path = " ".join(str(rng.randrange(1, 9)) for _ in range(rng.choice([1, 2, 3, 4]))) if kind == "A" else ""
        rows.append((i, T0 + dt.timedelta(seconds=rng.randrange(60_000)), rng.choice("cd"), kind, "ip", str(rng.randrange(4)), f"p{rng.randrange(5)}", "IGP", "nh", path))
    return rows


def replay(rows, window=3600, segment=28_800):
    """Applies the updates one by one and looks at the state at the end of each window."""
    epoch = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds())
    out, state, by = {}, {}, defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        by[r[2], epoch(r[1]) // segment, epoch(r[1]) // window].append(r)
    for (c, s, w), updates in sorted(by.items()):
        paths = state.setdefault((c, s), {})
        for r in updates:
            clean = " ".join(x for i, x in enumerate(r[9].split()) if i == 0 or x != r[9].split()[i - 1])
            if r[3] == "W":
                paths.pop((r[5], r[6]), None)
            elif len(clean.split()) >= 2:
                paths[r[5], r[6]] = clean
        for e, n in Counter(e for p in paths.values() for e in edges_of(p)).items():
            out[c, w * window, *e] = n
    return out


def test_live_edges_equal_an_ordered_replay(spark):
    rows = random_log()
    log = topo.with_segment(update_log(spark.createDataFrame(rows + rows[:30], COLUMNS), 3600))
    live = topo.live_edges(log, ["collector"], 3600)
    got = {(r.collector, int(r.t), r.u, r.v): r.refs for r in live.select("collector", (F.unix_micros("w") / 1_000_000).alias("t"), "u", "v", "refs").collect()}
    assert got == replay(rows)


def test_short_announcements_and_unknown_withdrawals(spark):
    key = lambda i, s, kind, peer, prefix, path: (i, T0 + dt.timedelta(hours=s), "c", kind, "ip", peer, prefix, "IGP", "nh", path)
    rows = [key(0, 0, "A", "100", "X", "1 2 3"), key(1, 1, "A", "200", "X", "1 2"), key(2, 2, "A", "100", "X", "7"), key(3, 3, "W", "100", "X", ""), key(4, 4, "W", "200", "X", ""), key(5, 5, "W", "300", "Q", "")]
    log = topo.with_segment(update_log(spark.createDataFrame(rows, COLUMNS), 3600))
    live = defaultdict(set)
    for r in topo.live_edges(log, ["collector"], 3600).collect():
        live[r.w.hour].add((r.u, r.v, r.refs))
    assert live == {0: {(1, 2, 1), (2, 3, 1)}, 1: {(1, 2, 2), (2, 3, 1)}, 2: {(1, 2, 2), (2, 3, 1)}, 3: {(1, 2, 1)}}


def test_snapshot_rows_start_a_segment(spark):
    log = topo.with_segment(update_log(spark.createDataFrame([(1, T0 + dt.timedelta(minutes=5), "c", "W", "ip", "1", "X", "", "", "")], COLUMNS), 300))
    rib = spark.createDataFrame([("c", T0, "1", "X", [1, 2]), ("c", T0, "2", "X", [2, 3])], "collector string, segment timestamp, peer_as string, prefix string, path array<bigint>")
    every = log.select("collector", "segment", "ts", "w", "seq", "type", "peer_as", "prefix", "path").unionByName(topo.rib_as_log(rib))
    got = {(r.w.minute, r.u, r.v) for r in topo.live_edges(every, ["collector"]).collect()}
    assert got == {(0, 1, 2), (0, 2, 3), (5, 2, 3)}


def test_hand_computed_window(spark):
    u = lambda i, s, kind, peer, prefix, path, origin: (i, T0 + dt.timedelta(seconds=s), "c", kind, peer, {"p1": "100", "p2": "200"}[peer], prefix, origin, "nh", path)
    rows = [
        (0, T0 - dt.timedelta(seconds=100), "c", "A", "p1", "100", "X", "IGP", "nh", "1 2"),
        u(1, 0, "A", "p1", "X", "1 2 3", "IGP"), u(2, 10, "A", "p1", "X", "1 2 3", "IGP"), u(3, 20, "A", "p2", "X", "1 4 3", "INCOMPLETE"), u(4, 30, "W", "p1", "X", "", ""), u(5, 40, "A", "p1", "10.0.0.1/32", "1 2", "IGP"), u(6, 60, "W", "p2", "Z", "", ""),
    ]
    row = sv.stat_view(update_log(spark.createDataFrame(rows, COLUMNS), 300), ["collector", "w"]).filter("total_updates > 1").first()
    expected = dict(
        announcements=4, withdrawals=2, total_updates=6, ann_rate=4 / 60, wd_rate=2 / 60, wd_ann_ratio=0.5, ann_wd_ratio=2.0, unique_prefixes_ann=2, unique_prefixes_wd=2, new_prefixes=1, dups=1, flaps=1, origin_IGP=3, origin_INCOMPLETE=1,
        origin_changes=1, as_path_avg=2.75, as_path_max=3, as_path_std=0.5, unique_as_path_max=2, edit_distance_avg=0.5, edit_distance_max=1, edit_distance_dict_0=1, edit_distance_dict_1=1, edit_distance_unique_dict_0=1,
        edit_distance_unique_dict_1=1, number_rare_ases=1, rare_ases_ratio=1 / 11, imp_wd=1, imp_wd_spath=1, imp_wd_dpath=0, nadas=1, unique_peers=2,
    )
    # the fixture's window has prefixes {X} before it and counts peers by AS
    assert {k: round(row[k], 9) for k in expected} == {k: round(v, 9) for k, v in expected.items()}


def test_ego_filters(spark):
    log = update_log(spark.createDataFrame([(1, T0, "c", "A", "", "5", "x", "", "", "1 2 3"), (2, T0, "c", "A", "", "5", "x", "", "", "9 7 8"), (3, T0, "c", "W", "", "3", "x", "", "", ""), (4, T0, "c", "W", "", "5", "x", "", "", ""), (5, T0, "c", "A", "", "5", "x", "", "", "3 8")], COLUMNS))
    ego = spark.createDataFrame([("c", 3)], "collector string, asn bigint")
    kept = lambda rule: {r.seq for r in sv.ego_filter(log, ego, 7, ["collector"], rule).collect()}
    assert kept("origin_or_target") == {1, 2, 3} and kept("any_hop") == {1, 5}


def test_streamed_deltas_sum_to_the_state(spark, tmp_path):
    rows = random_log(400, 3)
    df = spark.createDataFrame(sorted(rows, key=lambda r: (r[1], r[0])), COLUMNS)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = stream.read_stream(spark, str(tmp_path / "in"), df.schema)
    deltas = stream.run_available(stream.edge_deltas(source), "deltas_test", str(tmp_path / "cp"))
    got = {(r.collector, r.u, r.v): r.n for r in deltas.groupBy("collector", "u", "v").agg(F.sum("delta").alias("n")).filter("n <> 0").collect()}
    last = {}
    for (c, w, u, v), n in replay(rows, 3600, 10**12).items():
        last.setdefault((c, w), {})[c, u, v] = n
    ends = {c: max(w for k, w in last if k == c) for c, _ in last}
    assert got == {k: n for c, w in ends.items() for k, n in last[c, w].items()}


def test_a_late_copy_in_another_batch_changes_nothing(spark, tmp_path):
    key = lambda i, path: (i, T0 + dt.timedelta(minutes=i), "c", "A", "ip", "1", "X", "IGP", "nh", path)
    for n, rows in enumerate(([key(1, "1 2"), key(2, "2 3")], [key(1, "1 2"), key(3, "7")], [key(2, "2 3")])):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = stream.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], COLUMNS).schema, 1)
        deltas = stream.run_to_parquet(stream.edge_deltas(source), str(tmp_path / "out"), str(tmp_path / "cp"))
        left = {(r.u, r.v): r.n for r in deltas.groupBy("u", "v").agg(F.sum("delta").alias("n")).filter("n <> 0").collect()}
        assert left == {(2, 3): 1}, n
    assert deltas.count() == 3


def test_streamed_state_of_many_keys_in_one_call_a_bucket(spark, tmp_path):
    key = lambda i, c, p, x, kind, path, minute: (i, T0 + dt.timedelta(minutes=minute), c, kind, "ip", p, x, "IGP", "nh", path)
    many = [key(i, "c", str(i), "X", "A", "1 2", i % 50) for i in range(300)]
    # three keys that join to the same text
    alike = [key(400, "a", "bc", "d", "A", "5 6", 1), key(401, "ab", "c", "d", "A", "5 6", 1), key(402, "a", "b", "cd", "A", "5 6", 1)]
    later = [key(500, "ab", "c", "d", "W", "", 60), key(501, "a", "bc", "d", "A", "6 7", 61), *[key(600 + i, "c", str(i), "X", "W", "", 62) for i in range(300)], key(950, "ab", "c", "d", "A", "8 9", 63)]
    for rows in (many + alike, later):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = stream.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], COLUMNS).schema, 1)
        deltas = stream.run_to_parquet(stream.edge_deltas(source, buckets=2), str(tmp_path / "out"), str(tmp_path / "cp"))
    left = {(r.collector, r.u, r.v): r.n for r in deltas.groupBy("collector", "u", "v").agg(F.sum("delta").alias("n")).filter("n <> 0").collect()}
    assert left == {("a", 5, 6): 1, ("a", 6, 7): 1, ("ab", 8, 9): 1}
    assert deltas.count() == 303 + 1 + 2 + 300 + 1


def test_streamed_windows_equal_the_batch(spark, data, tmp_path):
    rows = table(spark, data, "updates")
    rows.write.parquet(str(tmp_path / "in"))
    source = stream.read_stream(spark, str(tmp_path / "in"), rows.schema)
    counts = stream.run_to_parquet(stream.window_counts(source, 60, "400 days"), str(tmp_path / "out"), str(tmp_path / "cp"), "complete")
    got = {(r.collector, r.w): (r.announcements, r.withdrawals, r.total_updates) for r in counts.collect()}
    batch = sv.volumes(update_log(rows, 3600), ["collector", "w"])
    assert got == {(r.collector, r.w): (r.announcements, r.withdrawals, r.total_updates) for r in batch.collect()}
