import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.llm.mixing import mix
from pathloom.llm.packing import best_fit_decreasing, pack, packing_report
from pathloom.llm.tokens import DEFAULT_RANKS, PATTERN, _encoder, count_tokens, with_tokens


def brute_fit(sizes, capacity):
    room, n = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [b for b in range(len(room)) if room[b] >= sizes[i]]
        if fits:
            b = min(fits, key=lambda b: room[b])
            room[b] -= sizes[i]
        else:
            room.append(capacity - sizes[i])
        n.append(None)
    return sorted(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=80))
def test_best_fit_equals_brute_force(sizes):
    s = np.array(sizes, dtype=np.int64)
    bins, n = best_fit_decreasing(s, 37)
    room = 37 - np.bincount(bins, weights=s, minlength=n) if n else np.array([])
    assert sorted(room.tolist()) == brute_fit(sizes, 37)


def test_pack_keeps_items_whole_and_cuts_only_large_ones(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 0, 1, 5, 100, 101, 200, 250, 999, rng.randrange(1, 100)])) for i in range(3000)] + [(7, 100), (7, 100)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("pieces", F.lit("clash"))
    for per_task in (250_000, 400):
        got = pack(df, "doc_id", "tokens", 100, per_task).collect()
        used = {}
        for r in got:
            if r.container_id is not None:
                used[r.container_id] = used.get(r.container_id, 0) + r.piece_size
        assert max(used.values()) <= 100
        assert sum(used.values()) == sum(s or 0 for _, s in rows)
        one = {i: s or 0 for i, s in rows if i != 7}
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append(r)
        assert set(by) == {i for i, _ in rows}
        for i, s in one.items():
            p = sorted(by[i], key=lambda r: r.piece_no)
            assert [x.piece_size for x in p] == ([100] * (s // 100) + [s % 100] * (s % 100 > 0) if s else [0])
            assert all(x.pieces == (len(p) if s else 0) for x in p) and [x.piece_start for x in p] == [100 * n for n in range(len(p))]
    assert packing_report(pack(df, "doc_id", "tokens", 100), 100).first().fill > 0.97
    assert pack(df.limit(0), "doc_id", "tokens", 100).count() == 0


def test_token_counts(spark):
    texts = ["", None, "The peer was reset.", "  \n", "経路を再広報した。", "x" * 100_001, " " * 100_000 + "y", "<|endoftext|>", "a" + "\n\t" * 4000, "a" + " \u3000" * 600 + "\x1c" * 1100 + "\n" * 999 + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("tokens", F.lit("clash"))
    got = {r.i: r.n for r in with_tokens(df, "text", "n").collect()}
    enc = _encoder(DEFAULT_RANKS, PATTERN)
    assert [got[i] for i in (0, 1)] == [0, 0]
    assert [got[i] for i in range(2, len(texts))] == [len(enc.encode_ordinary(t)) for t in texts[2:]]  # long ones too


def test_long_runs_of_white_space_count_as_the_pattern_splits_them():
    rng, enc = random.Random(1), _encoder(DEFAULT_RANKS, PATTERN)
    parts = ["a", "B ", " " * 999, " " * 1001, "\n" * 1200, "\x1c" * 1100, "é", ".", " \t" * 700, "\u3000" * 1001, "12", "'s"]
    for _ in range(150):
        text = "".join(rng.choices(parts, k=rng.randint(1, 8)))
        assert count_tokens(enc, text) == len(enc.encode_ordinary(text))
    assert count_tokens(enc, " " * 5_000_000 + "x") == 5_000_000  # more than the pattern's own stack can hold


def corpus(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["A ", "a", "a", "b", "c", "other", None]), rng.choice([None, 0, 3, 50, 80, rng.randrange(1, 900), 9000])) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def test_mixture_meets_reachable_shares(spark):
    rows, df = corpus(spark)
    stock = {}
    for _, s, t in rows:
        stock[(s or "").strip().lower()] = stock.get((s or "").strip().lower(), 0) + (t or 0)
    targets = spark.createDataFrame([(" a", 0.15, 1), ("B", 0.30, 3), ("c", 0.45, 2), ("gone", 0.1, 4)], "source string, target_share double, max_repeats int")
    mixture, report = mix(df, "doc_id", "source", "tokens", targets)
    total = sum(stock.values())
    docs = mixture.collect()
    assert len(docs) == len(rows)
    caps = {"a": 1, "b": 3, "c": 2}
    assert all(0 <= r.copies <= caps.get(r.source, 0) and r.rate <= caps.get(r.source, 0) + 1e-9 for r in docs)
    by = {r.source: r for r in report.collect()}
    assert {s: r.reachable for s, r in by.items()} == {s: stock.get(s, 0) * {**caps, "gone": 4}[s] >= share * total for s, share in (("a", 0.15), ("b", 0.3), ("c", 0.45), ("gone", 0.1))}
    for s in ("a", "b"):
        expected = sum(r.rate * r.tokens for r in docs if r.source == s)
        assert expected == pytest.approx({"a": 0.15, "b": 0.3}[s] * total, rel=1e-5)
        assert by[s].mixed_tokens == pytest.approx(expected, abs=50)  # the short documents make up for the long ones
        assert by[s].mixed_tokens == sum(r.copies * r.tokens for r in docs if r.source == s)
        assert all(abs(r.copies - r.rate) < 1 + 1e-6 for r in docs if r.source == s)
        rates = sorted({(r.tokens, round(r.rate, 9)) for r in docs if r.source == s and 0 < r.tokens})
        assert len({t for t, _ in rates}) == len(rates)  # one rate for each length: the tilt is exponential in it
    assert by["c"].mixed_tokens == 2 * stock["c"] and sum(r.reached_share for r in by.values()) == pytest.approx(1)


def test_mixture_of_a_feasible_size_keeps_all_shares_and_parts_do_not_matter(spark):
    _, df = corpus(spark)
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 3), ("c", 0.5, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mix(df, "doc_id", "source", "tokens", targets, feasible=True, per_task=50)
    for r in report.collect():
        assert r.reached_share == pytest.approx(r.target_share, abs=1e-4)
    used = {r.source: r.t for r in mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    assert all(used[r.source] == r.mixed_tokens for r in report.collect())


def test_a_share_at_its_cap_is_reachable_and_one_above_is_not(spark):
    df = spark.createDataFrame([(1, "s", 3), (2, "s", 7), (3, "t", 10)], "doc_id long, source string, tokens long")
    for share, fine in ((1.0, True), (1.0000000001, False), (0.9999999999, True)):
        targets = spark.createDataFrame([("s", share, 2)], "source string, target_share double, max_repeats int")
        assert mix(df, "doc_id", "source", "tokens", targets)[1].first().reachable is fine


def test_rates_are_exponential_in_tokens(spark):
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate([10, 20, 30, 40] * 50)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("s", 0.5, 5)], "source string, target_share double, max_repeats int")
    rates = {r.tokens: r.rate for r in mix(df, "doc_id", "source", "tokens", targets)[0].collect()}
    assert rates[20] / rates[10] == pytest.approx(rates[30] / rates[20]) == pytest.approx(rates[40] / rates[30])


def test_mixture_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("s", 0.5, 5), (None, 0.5, 1), ("t", None, None)], "source string, target_share double, max_repeats int")
    mixture, report = mix(df, "doc_id", "source", "tokens", targets)
    assert mixture.count() == 0 and {r.source for r in report.collect()} == {"s", "t"}
