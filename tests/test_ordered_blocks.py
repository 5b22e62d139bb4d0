"""Ordered operators cut into chunks and blocks, against the plain order of each key."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from pathloom.operators.chunked import with_positions, with_predecessor
from pathloom.operators.joins import temporal_edges
from pathloom.operators.ordered import autocorrelation, rolling, sessions, trailing_sequences
from pathloom.operators.selection import overlapping

T0 = dt.datetime(2025, 7, 1)


def sample(n=600):
    rng = random.Random(5)
    return [(i, rng.choice(["hot", "hot", "hot", "b", None]), T0 + dt.timedelta(minutes=rng.choice([1, 7, 60]) * rng.randrange(900)) if rng.random() < 0.97 else None, float(rng.randrange(50))) for i in range(n)]


def by_key(rows):
    out = defaultdict(list)
    for r in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        out[r[1]].append(r)
    return out


def test_positions_and_predecessors(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "i long, k string, t timestamp, x double")
    want = {(k, r[0]): (n, s[n - 1][3] if n else None) for k, s in by_key(rows).items() for n, r in enumerate(s)}
    for chunk in (3600, 86_400, 10**9):
        pos = {(r.k, r.i): r._pos for r in with_positions(df, ["k"], "t", ["i"], chunk).collect()}
        before = {(r.k, r.i): r.before for r in with_predecessor(df, ["k"], "t", ["i"], "x", "before", chunk).collect()}
        assert pos == {k: v[0] for k, v in want.items()} and before == {k: v[1] for k, v in want.items()}


def test_blocks_do_not_show_in_results(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "i long, k string, t timestamp, x double")
    for block in (5, 40, 50_000):
        got = {r.i: (r.rolling_median, r.trailing_mean) for r in rolling(df, ["k"], "t", ["i"], "x", block=block).collect()}
        seqs = {r.i: [x[0] for x in r.sequence] for r in trailing_sequences(df, ["k"], "t", ["i"], ["x"], 4, block=block).collect()}
        edges = {(r.source, r.target, r.step) for r in temporal_edges(df, ["k"], "t", ["i"], "i", 3, block=block).collect()}
        want_edges, n = set(), 0
        for s in by_key(rows).values():
            for p, r in enumerate(s):
                n += 1
                near = sorted(y[3] for y in s[max(0, p - 6) : p + 6])
                middle = (near[(len(near) - 1) // 2] + near[len(near) // 2]) / 2 if len(near) >= 4 else None
                tail = [y[3] for y in s[max(0, p - 11) : p + 1]]
                assert got[r[0]][0] == middle and abs(got[r[0]][1] - sum(tail) / len(tail)) < 1e-9
                last = [y[3] for y in s[max(0, p - 3) : p + 1]]
                assert seqs[r[0]] == [last[0]] * (4 - len(last)) + last
                want_edges |= {(s[p - g][0], r[0], g) for g in (1, 2, 3) if p >= g}
        assert edges == want_edges and len(got) == len(seqs) == n


def test_sessions_over_chunks(spark):
    rows = sample(300)
    df = spark.createDataFrame(rows, "i long, k string, t timestamp, x double")
    want = {}
    for s in by_key(rows).values():
        number = 0
        for p, r in enumerate(s):
            number += p == 0 or (r[2] - s[p - 1][2]).total_seconds() > 1800
            want[r[0]] = number
    for chunk in (1800, 7200, 10**9):
        assert {r.i: r.event_no for r in sessions(df, ["k"], "t", 30, chunk_seconds=chunk).collect()} == want, chunk


def test_autocorrelation_over_blocks(spark):
    rng = random.Random(2)
    series = {k: [rng.random() + (i % 5) for i in range(n)] for k, n in (("a", 200), ("b", 7), (None, 50))}
    rows = [(k, T0 + dt.timedelta(minutes=5 * i), x) for k, s in series.items() for i, x in enumerate(s)] + [("flat", T0 + dt.timedelta(minutes=i), 3.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, t timestamp, x double")
    want = {}
    for k, s in series.items():
        m = sum(s) / len(s)
        for g in range(4, 13):
            if len(s) > g:
                want[k, g] = sum((a - m) * (b - m) for a, b in zip(s, s[g:])) / sum((a - m) ** 2 for a in s)
    for block in (16, 64, 8192):
        got = {(r.k, r.lag): r.acf for r in autocorrelation(df, ["k"], "t", "x", range(4, 13), block).collect()}
        assert {k for k in got if k[0] != "flat"} == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
        assert all(v is None for k, v in got.items() if k[0] == "flat")


def test_overlaps(spark):
    rng = random.Random(8)
    span = lambda i: (i, rng.choice("ab"), T0 + dt.timedelta(minutes=(m := rng.randrange(3000))), T0 + dt.timedelta(minutes=m + rng.choice([0, 10, 500])))
    left, right = [span(i) for i in range(60)], [span(i) for i in range(60)]
    shape = "i long, k string, s timestamp, e timestamp"
    got = overlapping(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape), ["k"], "s", "e", "s", "e", 3600).select("i", "other_i").collect()
    assert sorted((r.i, r.other_i) for r in got) == sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] < b[3] and a[3] > b[2])
