import random

import brute
import pytest
from pyspark.sql import functions as F

from pathloom.functions import net, paths


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def mapped(spark, values, function, kind="string"):
    rows = one_column(spark, values, kind).select("i", function(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


def odd_networks():
    rng = random.Random(1)
    out = [None, "", "  ", "10.1.2.3", " 10.1.2.3/8 ", "010.001.002.003/24", "0.0.0.0/0", "::/0", "::1", "2001:DB8::/32", "1::8/127", "not a net", "10.0.0.0/33", "::/129", "300.1.1.1/8", "2001:db8:c1ab::/44", "2001:db8:102a:ed00::/56", "2001:db8:a::/44", "f::/4", "1::/3", "0abc::/16", "abcd:1::/17", "2001:db8:1:2:3:4::/95", "2001:DB8:1:F::/63", "1:2:3::/40", "1:2:3::/20", "2001:db8::/32\n", "10.0.0.0/8\n", "1:2", "::ffff:10.1.2.3/120"]
    for _ in range(400):
        groups = [rng.choice(["0", "0", "0000", "db8", "0db8", "F", "1a0", "abcd"]) for _ in range(8)]
        text = ":".join(groups)
        at, n = rng.randrange(8), rng.randrange(1, 8)
        if rng.random() < 0.5 and at + n <= 8:
            text = ":".join(groups[:at]) + "::" + ":".join(groups[at + n :])
        out.append(f"{text}/{rng.randrange(129)}")
        out.append(f"{'.'.join(str(rng.randrange(256)) for _ in range(4))}/{rng.randrange(33)}")
    return out


def test_networks_equal_the_standard_library(spark):
    values = odd_networks()
    expected = [brute.network(v) for v in values]
    given = mapped(spark, values, net.network)
    odd = "::ffff:10.1.2.3/120"  # the standard library prints its last part as IPv4
    assert [x for x in zip(values, given, expected) if x[1] != x[2] and x[0] != odd] == []
    assert mapped(spark, [odd], net.network) == ["::ffff:a01:200/120"]


def test_addresses(spark):
    values = [" 192.0.2.17", "2001:0db8:00b5:0000:0000:0000:0000:01a1", "2001:DB8:D7::1A1", "2001:db8:af:0:0:0:0:1a1", "1:0:0:2:0:0:0:3", None, "peer"]
    assert mapped(spark, values, net.address) == ["192.0.2.17", "2001:db8:b5::1a1", "2001:db8:d7::1a1", "2001:db8:af::1a1", "1:0:0:2::3", None, "peer"]


def test_as_numbers(spark):
    values = ["1002040", "AS1002040", "as1002040 ", "15.19000", " 7 ", "", None, "007", "odd", "12\n"]
    assert mapped(spark, values, net.as_number) == ["1002040", "1002040", "1002040", str(15 * 65536 + 19000), "7", None, None, "7", "odd", "12"]


VECTORS = {
    "3356 3356 64512 1299 {10 20} 30": "3356 1299 30",
    "{1,2} 5 x 5 0 6": "5 6",
    "1 65000 1 2": "1 2",
    "1 2} 3": "1 3",
    "": "",
    "1 2\n": "1 2",
    "1 {2 3": "1",
    "1 {2} 3 {4 {5 6} 7": "1 3 7",
    "64511 64512 65534 65535 65536 4199999999 4200000000 4294967294 4294967295 4294967296": "64511 65536 4199999999 4294967296",
}


def test_path_vectors(spark):
    assert mapped(spark, list(VECTORS), paths.clean_path) == list(VECTORS.values())
    assert mapped(spark, [None], paths.clean_path) == [""]


def test_random_paths_equal_brute_force(spark):
    rng = random.Random(2)
    tokens = ["1", "1", "22", "0", "64512", "65535", "23456", "4200000001", "{3", "4}", "{5}", "{6,7}", "x", "?", "--", "}", "{", "a{b", "}{", "007", "99", "1"]
    values = [rng.choice([" ", "  "]).join(rng.choices(tokens, k=rng.randrange(12))) for _ in range(3000)]
    given = mapped(spark, values, paths.clean_path)
    assert [x for x in zip(values, given, map(brute.clean, values)) if x[1] != x[2]] == []


def test_every_special_number_goes(spark):
    low = spark.range(64000, 66500).select(F.col("id"), paths.clean_path(F.col("id").cast("string")).alias("p"), paths.is_public_asn(F.col("id")).alias("ok"))
    assert low.filter((F.col("p") != "") != F.col("ok")).count() == 0
    edge = spark.range(4199999990, 4200000010).union(spark.range(4294967280, 4294967300)).select("id", paths.clean_path(F.col("id").cast("string")).alias("p"), paths.is_public_asn(F.col("id")).alias("ok"))
    assert edge.filter((F.col("p") != "") != F.col("ok")).count() == 0


def test_edges_lengths_and_origin(spark):
    df = spark.createDataFrame([([3, 1, 3],), ([5],), ([],), ([1, 1, 2],)], "p array<bigint>")
    rows = df.select(paths.path_edges(F.col("p")).alias("e"), paths.path_length(F.col("p")).alias("n"), paths.origin_as(F.col("p")).alias("o")).collect()
    assert [[tuple(e) for e in r.e] for r in rows] == [[(1, 3), (1, 3)], [], [], [(1, 2)]]
    assert [(r.n, r.o) for r in rows] == [(3, "3"), (1, "5"), (0, ""), (3, "2")]


@pytest.mark.parametrize("a,b,d", [([1, 2, 3], [1, 3, 4], 2), ([10, 20, 30, 40], [20, 30, 50], 2), ([], [1], 0), (None, [1], 0)])
def test_edit_distance_vectors(spark, a, b, d):
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    assert df.select(paths.edit_distance(F.col("a"), F.col("b")).alias("d")).first().d == d


def test_edit_distance_random(spark):
    rng = random.Random(3)
    pairs = [([rng.randrange(6) for _ in range(rng.randrange(9))], [rng.randrange(6) for _ in range(rng.randrange(9))]) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>")
    given = [r.d for r in df.select(paths.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert given == [brute.levenshtein(a, b) for a, b in pairs]


@pytest.mark.parametrize("hops,expected", [([1, 1, 0, -1], (True, None, 4)), ([-1, 1], (False, 1, 2)), ([0, 0], (False, 1, 2)), ([None, -1, 0], (False, 2, 2)), ([], (True, None, 0))])
def test_valley_free_vectors(spark, hops, expected):
    df = spark.createDataFrame([(hops,)], "h array<int>")
    assert tuple(df.select(paths.valley_free(F.col("h")).alias("v")).first().v) == expected


def test_dropped_numbers_join_repeats(spark):
    df = spark.createDataFrame([("1 9 1 2",)], "x string")
    assert df.select(paths.parse_path(F.col("x"), F.array(F.lit(9).cast("bigint"))).alias("p")).first().p == [1, 2]
