import datetime as dt
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pathloom.llm.heavy_items import frequent_items, heavy_items
from pathloom.llm.runs import collapse_runs, run_members

T0 = dt.datetime(2025, 7, 1)


def brute(rows, gap):
    keys = defaultdict(set)
    for k, t, o, x in rows:
        if t is not None:
            keys[k].add((t, o, x))
    runs = []
    for k, events in keys.items():
        ordered = sorted(events, key=lambda e: e[:2])
        for e in ordered:
            if runs and runs[-1][0] == k and runs[-1][1][-1][2] == e[2] and (e[0] - runs[-1][1][-1][0]).total_seconds() <= gap:
                runs[-1][1].append(e)
            else:
                runs.append((k, [e]))
    return runs


def sample():
    rng = random.Random(11)
    rows, order = [], list(range(1, 1500))
    rng.shuffle(order)
    for o in order:
        k = rng.choice(["hot"] * 6 + ["a", "b", None])
        t = None if rng.random() < 0.02 else T0 + dt.timedelta(seconds=rng.choice([0, 900, 899, 901, 60]) + 300 * rng.randrange(300))
        rows.append((k, t, o, rng.choice(["x", "x", "x", "y", None])))
    return rows + rng.sample(rows, 50)


def spec(df):
    return {"events": df, "keys": {"k": F.col("k")}, "time": F.col("t"), "order": F.col("o"), "same": [F.col("x").alias("x")]}


def test_runs_and_members_against_brute_force_over_any_chunks(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "k string, t timestamp, o long, x string").withColumn("events", F.lit(0))
    truth = brute(rows, 900)
    expected = Counter((k, e[0][2], e[0][0], e[-1][0], len(e), (e[-1][0] - e[0][0]).total_seconds(), min(x[1] for x in e)) for k, e in truth)
    members = {(min(x[1] for x in e), x[1]) for _, e in truth for x in e if x[1] != min(y[1] for y in e)}
    for chunk in (1000, 3600, 21_600, 10_000_000):
        got = collapse_runs(**spec(df), chunk_seconds=chunk).select("k", "event.x", "first_ts", "last_ts", "events", "duration_s", "first_order")
        assert Counter(tuple(r) for r in got.collect()) == expected, chunk
        assert {tuple(r) for r in run_members(**spec(df), chunk_seconds=chunk).collect()} == members, chunk


def test_one_run_over_many_chunks(spark):
    rows = [("k", T0 + dt.timedelta(seconds=600 * i), 1000 - i, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t timestamp, o long, x string")
    got = collapse_runs(**spec(df), chunk_seconds=1800).collect()
    assert [(r.events, r.first_order, r.duration_s) for r in got] == [(200, 801, 600.0 * 199)]
    assert run_members(**spec(df), chunk_seconds=1800).count() == 199


def test_empty_and_all_null_times(spark):
    df = spark.createDataFrame([("k", None, 1, "x")], "k string, t timestamp, o long, x string")
    assert collapse_runs(**spec(df)).count() == 0 and run_members(**spec(df)).count() == 0


def test_heavy_items(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aaab") if rng.random() < 0.4 else f"v{i}", None if i % 3 else "z" * 5000) for i in range(2000)]
    df = spark.createDataFrame(rows + rows[:100], "seq long, p string, q string").withColumn("field", F.lit("clash"))
    fields = {"p": F.col("p"), "q": F.col("q")}
    count = Counter(("p", r[1]) for r in rows) + Counter(("q", r[2]) for r in rows if r[2])
    top = heavy_items(df, fields, F.col("seq"), 3).collect()
    assert {(r.field, r.item, r.n, r.records) for r in top if r["rank"] <= 2 and r.n > 1} == {(f, i, n, 2000) for (f, i), n in count.items() if n > 1}
    assert [r.item for r in top if r.field == "p" and r["rank"] == 3] == [min(f"v{r[0]}" for r in rows if r[1][0] == "v")]  # ties by text
    assert {(r.field, r.item) for r in frequent_items(df, fields, F.col("seq"), 0.05).collect()} == {k for k, n in count.items() if n >= 100}
    assert heavy_items(df.limit(0), fields, F.col("seq"), 3).count() == 0
