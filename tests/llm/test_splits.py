import random

import numpy as np
from pyspark.sql import functions as F

from pathloom.llm.splits import allocate_bins, largest_differencing, split_together

SHARES = {"train": 0.7, "validation": 0.1, "test": 0.2}


def sums(weights, bins, n):
    return np.bincount(bins, weights=weights, minlength=n)


def test_differencing_is_far_more_even_than_dealing_out():
    rng = np.random.default_rng(1)
    w = np.round(rng.lognormal(3, 1.2, 3000)).astype(float) + 1
    s = sums(w, largest_differencing(w, 20), 20)
    assert s.sum() == w.sum() and s.max() - s.min() <= 2
    dealt = sums(w, np.arange(len(w)) % 20, 20)
    assert s.max() - s.min() < (dealt.max() - dealt.min()) / 20


def test_differencing_of_few_and_equal_weights():
    assert list(largest_differencing(np.array([]), 4)) == []
    assert sorted(largest_differencing(np.ones(8), 4)) == [0, 0, 1, 1, 2, 2, 3, 3]
    s = sums(np.array([8.0, 7, 6, 5, 4]), largest_differencing(np.array([8.0, 7, 6, 5, 4]), 2), 2)
    assert abs(s[0] - s[1]) == 2  # differencing's well-known answer here


def test_bins_go_to_splits_in_proportion():
    names = allocate_bins([1.0] * 100, SHARES)
    assert {s: names.count(s) for s in SHARES} == {"train": 70, "validation": 10, "test": 20}
    names = allocate_bins([50.0] + [1.0] * 50, SHARES)
    assert names[0] == "train"


def brute_components(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, e, w in rows:
        for x in (("e", e), ("w", w)):
            if x[1] is not None:
                find(x)
        if e is not None and w is not None:
            parent[find(("e", e))] = find(("w", w))
    return {i: find(("e", e)) if e is not None else find(("w", w)) if w is not None else ("r", i) for i, e, w in rows}


def test_related_rows_stay_together_and_shares_are_met(spark):
    rng = random.Random(4)
    rows = [(i, f"e{rng.randrange(60)}" if rng.random() < 0.2 else None, f"w{i // 2}" if rng.random() < 0.95 else None) for i in range(3000)]
    rows += [(5000 + i, "hot", f"w{9000 + i}") for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, event string, window string").withColumns({"component": F.lit("clash"), "split_name": F.lit("clash")})
    for per_task in (200_000, 300):
        out = split_together(df, "row_id", "event", "window", SHARES, per_task=per_task).collect()
        assert len(out) == len(rows)
        truth, seen, to = brute_components(rows), {}, {}
        for r in out:
            assert seen.setdefault(truth[r.row_id], r.component) == r.component
            assert to.setdefault(r.component, r.split_name) == r.split_name
        assert len(set(seen.values())) == len(seen)
        for s, share in SHARES.items():
            assert abs(sum(r.split_name == s for r in out) / len(out) - share) < 0.02


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, None), (1, None, None), (2, "", None), (3, None, ""), (4, "a", "w"), (5, None, "w")]
    df = spark.createDataFrame(rows, "row_id long, event string, window string")
    out = split_together(df, "row_id", "event", "window", SHARES)
    by = {}
    for r in out.collect():
        by.setdefault(r.row_id, set()).add((r.component, r.split_name))
    assert all(len(x) == 1 for x in by.values()) and by[4] == by[5] and len(by) == 5
    assert split_together(df.limit(0), "row_id", "event", "window", SHARES).count() == 0
