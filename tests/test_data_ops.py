"""Grids, implausible readings, heavy keys and snapshot changes against plain Python."""

import datetime as dt
import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from pathloom.operators.grid import counter_increments, increments_to_cells, regular_windows
from pathloom.operators.heavy_keys import key_profile
from pathloom.operators.snapshot_diff import snapshot_changes, snapshot_index, undirected
from pathloom.operators.spikes import exact_medians, implausible

T0 = dt.datetime(2025, 7, 1)
at = lambda minutes: T0 + dt.timedelta(minutes=minutes)


def test_counter_resets_gaps_and_overlap(spark):
    rows = [("a", at(0), 100), ("a", at(10), 160), ("a", at(15), 30), ("a", at(100), 80), ("a", None, 5), ("a", at(3), None), (None, at(0), 1), (None, at(5), 4)]
    df = spark.createDataFrame(rows, "s string, t timestamp, v long")
    inc = counter_increments(df, ["s"], "t", "v", block_seconds=600)
    got = sorted((r.s or "", r.from_ts, r.to_ts, r.increment) for r in inc.collect())
    assert got == [("", at(0), at(5), 3), ("a", at(0), at(10), 60), ("a", at(10), at(15), 30), ("a", at(15), at(100), 50)]
    cells = {(r.s, r.cell_start): (r.amount, r.covered) for r in increments_to_cells(inc, ["s"], 300, 1200).collect()}
    assert cells == {("a", at(0)): (30.0, 1.0), ("a", at(5)): (30.0, 1.0), ("a", at(10)): (30.0, 1.0), (None, at(0)): (3.0, 1.0)}


def test_increments_off_the_grid_are_shared_out(spark):
    df = spark.createDataFrame([("a", at(2), 0), ("a", at(12), 100)], "s string, t timestamp, v long")
    cells = {r.cell_start: (round(r.amount, 6), round(r.covered, 6)) for r in increments_to_cells(counter_increments(df, ["s"], "t", "v"), ["s"], 300).collect()}
    assert cells == {at(0): (30.0, 0.6), at(5): (50.0, 1.0), at(10): (20.0, 0.4)}


def test_regular_windows(spark):
    rows = [(1, "a", at(0), 5), (2, "a", at(1), 6), (3, "a", at(16), 7), (4, "a", at(475), 1), (5, "a", at(480), 2), (6, "a", at(490), 3), (6, "a", at(490), 3), (7, "a", at(20), None), (8, "a", None, 4), (9, None, at(0), 1)]
    df = spark.createDataFrame(rows, "feature_id long, s string, window_start timestamp, total_updates long").withColumn("missing", F.lit("clash"))
    out = regular_windows(df, ["s"])
    got = sorted((r.s or "", r.cell_start, r.amount, r.missing) for r in out.filter("s is null or cell_start < '2025-07-01 00:30:00' or cell_start >= '2025-07-01 07:50:00'").collect())
    assert got == [("", at(0), 1.0, False), ("a", at(0), 6.0, False), ("a", at(5), None, True), ("a", at(10), None, True), ("a", at(15), 7.0, False), ("a", at(20), None, True), ("a", at(25), None, True), ("a", at(470), None, True), ("a", at(475), 1.0, False), ("a", at(480), 2.0, False), ("a", at(485), None, True), ("a", at(490), 3.0, False)]
    assert regular_windows(df.limit(0), ["s"]).count() == 0


def brute_flags(rows):
    series = defaultdict(dict)
    for fid, s, t, a, w, u in set(rows):
        for name, v in (("a", a), ("w", w), ("u", u)):
            if v is not None:
                series[s, name][(t is not None, t or T0, fid)] = (v, a + w if name == "u" and a is not None and w is not None else None)
    out = set()
    for (_, name), values in series.items():
        known = [v for v, _ in values.values() if v >= 0]
        m = statistics.median(known) if known else None
        order = sorted(values)
        runs, i = {}, 0
        while i < len(order):
            j = i
            while j < len(order) and values[order[j]][0] == values[order[i]][0]:
                j += 1
            runs |= {order[x]: j - i for x in range(i, j)}
            i = j
        for key, (v, parts) in values.items():
            if v < 0 or (m is not None and (v > 8 * m or v < m / 8)) or runs[key] >= 8 or (parts is not None and v != parts):
                out.add((key[2], name))
    return out


def test_implausible_against_brute_force_over_chunks(spark):
    rng = random.Random(7)
    rows = []
    for s in ("x", "y", None):
        level, value = rng.choice([5, 50, 900]), 7
        for i in range(260):
            value = value if rng.random() < 0.75 else rng.randrange(level // 2, level * 2 + 2)
            a = rng.choice([value] * 12 + [level * 20, -3, 0, None])
            w = rng.choice([level, level + 1, None])
            u = None if a is None or w is None else a + w + (rng.random() < 0.05)
            rows.append((len(rows), s, at(5 * i) if rng.random() < 0.97 else None, a, w, u))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "id long, s string, t timestamp, a long, w long, u long").withColumn("value", F.lit(1))
    expected = brute_flags(rows)
    for chunk in (1500, 3000, 86_400):
        got = implausible(df, ["s"], "t", "id", ["a", "w", "u"], {"u": ["a", "w"]}, chunk_seconds=chunk)
        found = {(r.id, r.measure) for r in got.filter("negative or bound or stuck or sum").collect()}
        assert found == expected, chunk
    assert implausible(df.limit(0), ["s"], "t", "id", ["a"]).count() == 0


def test_spikes_by_scaled_details(spark):
    rng = random.Random(4)
    values = [100 + rng.randrange(20) for _ in range(400)]
    for i in (50, 51, 200):
        values[i] = 700  # within eight times the median, but far from its neighbours
    rows = [(i, "s", at(i), v) for i, v in enumerate(values)] + [(1000 + i, "flat", at(i), 5 + 90 * (i == 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, s string, t timestamp, a long")
    got = implausible(df, ["s"], "t", "id", ["a"], chunk_seconds=10_000_000)
    details = defaultdict(list)
    smooth = lambda i, j: statistics.fmean(values[max(0, i - (1 << j) + 1) : i + 1])
    for i in range(len(values)):
        details[1].append((values[i] - values[i - 1]) / 2 if i else None)
        for j in (2, 3):
            details[j].append(smooth(i, j - 1) - smooth(i, j))
    scale = {j: statistics.median(abs(x) for x in d if x is not None) / 0.6745 for j, d in details.items()}
    expected = {i for i in range(400) if any(d[i] is not None and abs(d[i]) > 12 * scale[j] for j, d in details.items())}
    assert {r.id for r in got.filter("spike").collect()} == expected and {50, 200} <= expected  # a flat series has no scale
    assert {r.id for r in got.filter("bound").collect()} == {1030}


def test_exact_medians(spark):
    rng = random.Random(9)
    rows = [(k, v) for k in ("a", "b", None) for v in [rng.choice([0.0, -1.5, 3.25, 1e-9, 7e12, rng.random() * 10]) for _ in range(rng.choice([50, 51]))]]
    rows += [("one", 4.0), ("two", 4.0), ("two", 5.0), ("none", None), ("equal", 2.0), ("equal", 2.0)]
    known = defaultdict(list)
    for k, v in rows:
        if v is not None:
            known[k].append(v)
    got = {r.k: r.median for r in exact_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {k: statistics.median(v) for k, v in known.items()}


def test_regular_windows_difference_a_counter(spark):
    rows = [("a", at(m), float(v), m) for m, v in ((0, 5), (5, 0), (20, -4), (25, 7), (490, 2), (500, 3))]
    df = spark.createDataFrame(rows, "s string, window_start timestamp, total_updates double, feature_id long")
    got = [(r.cell_start, r.amount, r.missing) for r in regular_windows(df, ["s"]).orderBy("cell_start").collect()]
    assert got == [(at(0), 5.0, False), (at(5), 0.0, False), (at(10), None, True), (at(15), None, True), (at(20), -4.0, False), (at(25), 7.0, False), (at(490), 2.0, False), (at(495), None, True), (at(500), 3.0, False)]


def test_key_profile(spark):
    rows = [(1, "k", at(0), "p"), (2, "k", at(5), "q"), (2, "k", at(5), "q"), (3, "k", None, None), (4, None, at(1), "p"), (5, "m", None, None)]
    df = spark.createDataFrame(rows, "seq long, k string, t timestamp, p string")
    got = {r.k: tuple(r)[1:] for r in key_profile(df, {"k": F.col("k")}, ["k"], F.col("t"), F.col("p"), F.col("seq")).collect()}
    assert got == {"k": (3, at(0), at(5), 2, 5), "m": (1, None, None, 0, 5)}
    assert key_profile(df.limit(0), {"k": F.col("k")}, ["k"], F.col("t"), F.col("p"), F.col("seq")).count() == 0


def test_snapshot_changes_against_brute_force(spark):
    rng = random.Random(3)
    rows, states = [], defaultdict(dict)
    for pair in ("p", "q"):
        for stamp in ("s1", "s2", "s4", "s9"):
            for u in range(6):
                for v in range(u + 1, 6):
                    if rng.random() < 0.6:
                        w = rng.choice([1, 2, None])
                        states[pair, stamp][u, v] = w
                        rows += [(pair, stamp, *rng.choice([(u, v), (v, u)]), w)] * rng.choice([1, 1, 2])
            rows.append((pair, stamp, 3, 3, 9))
    rows.append(("q", "t0", 4, 4, 1))  # delivered, but holds no edge
    states["q", "t0"] = {}
    expected = set()
    for pair in ("p", "q"):
        stamps = sorted(s for p, s in states if p == pair)
        for a, b in zip(stamps, stamps[1:]):
            old, new = states[pair, a], states[pair, b]
            for e in old.keys() | new.keys():
                change = "added" if e not in old else "removed" if e not in new else "changed" if old[e] != new[e] else None
                if change:
                    expected.add((pair, b, *e, change))
    df = spark.createDataFrame(rows, "pair string, stamp string, source long, target long, weight int").withColumn("change", F.lit("clash"))
    got = snapshot_changes(undirected(df, ["pair", "stamp"]), snapshot_index(df, "pair", "stamp"), "pair", "stamp", ["source", "target"], ["weight"])
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(expected)
    empty = df.limit(0)
    assert snapshot_changes(undirected(empty, ["pair", "stamp"]), snapshot_index(empty, "pair", "stamp"), "pair", "stamp", ["source", "target"], ["weight"]).count() == 0
