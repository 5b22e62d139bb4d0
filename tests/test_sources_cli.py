"""Dumps, file lists, graph export, SQL functions, the command line and runs that are taken up again."""

import datetime as dt
import xml.etree.ElementTree as ET

from pathloom.__main__ import main
from pathloom.functions.register import register
from pathloom.operators import topology as topo
from pathloom.operators.evaluation import time_scoring
from pathloom.operators.statview import stat_view
from pathloom.sources.dumps import discovered_files, dump_counts, first_filled, read_dump, rib_rows, update_rows, write_gexf, write_rows
from pathloom.sources.files import nearest_file, snapshot_files
from pathloom.sources.segments import resume_windows
from pathloom.sources.updates import update_log

from test_topology_stream import COLUMNS, random_log  # isort: skip

LINES = [
    "TABLE_DUMP2|1751328000|B|192.0.2.1|64500|10.0.0.0/24|1 2 3|IGP|192.0.2.9|100|0|65000:1|NAG||",
    "BGP4MP|1751328005.5|A|192.0.2.1|64500|10.0.1.0/24|1 2|IGP|192.0.2.9|0|5||NAG||",
    "BGP4MP|1751328006|W|192.0.2.2|64501|10.0.1.0/24",
    "BGP4MP|oops|A|192.0.2.2|64501|10.0.2.0/24|1", "BGP4MP|1751328007|STATE|192.0.2.2|64501|x", "", "garbage",
]


def test_dumps(spark, tmp_path):
    (tmp_path / "d.txt").write_text("\n".join(LINES))
    dump = read_dump(spark, str(tmp_path / "d.txt"))
    assert tuple(dump_counts(dump).first()) == (6, 3, 1, 2, 2)
    assert sorted(r.prefix for r in rib_rows(dump).collect()) == ["10.0.0.0/24", "10.0.1.0/24"]
    ups = {(r.type, r.prefix, r.med, r.as_path, r.timestamp) for r in update_rows(dump).collect()}
    assert ("A", "10.0.1.0/24", "5", "1 2", dt.datetime(2025, 7, 1, 0, 0, 5, 500_000)) in ups and ("W", "10.0.1.0/24", "", "", dt.datetime(2025, 7, 1, 0, 0, 6)) in ups and len(ups) == 3
    assert dump_counts(dump.limit(0)).first().n_elements == 0


def test_files(spark, tmp_path):
    generated = snapshot_files(spark, "rrc91", "2025-07-01 00:00:00", "2025-07-02 00:00:00")
    assert generated.count() == 4  # the end counts
    assert discovered_files(spark, [f"{tmp_path}/*.gz"], generated).count() == 4
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.gz").write_text("")
    assert [r.path.rsplit("/", 1)[1] for r in discovered_files(spark, [f"{tmp_path}/b/*.gz"], generated).collect()] == ["x.gz"]
    assert first_filled(spark, [f"{tmp_path}/none", f"{tmp_path}/a", f"{tmp_path}/b"]) == f"{tmp_path}/b" and first_filled(spark, [f"{tmp_path}/a"]) is None
    day = lambda n: dt.date(2025, 7, n)
    files = spark.createDataFrame([("p1", day(1)), ("p5", day(5)), ("q5", day(5)), ("p20", day(20))], "path string, file_date date")
    dates = spark.createDataFrame([(day(n),) for n in (1, 3, 4, 6, 30)] + [(dt.date(2025, 6, 1),), (day(3),)], "date date")
    assert {r.date: r.path for r in nearest_file(files, dates).collect()} == {day(1): "p1", day(3): "p1", day(4): "p5", day(6): "p5", day(30): "p20", dt.date(2025, 6, 1): "p1"}
    assert {r.path for r in nearest_file(files.limit(0), dates).collect()} == {None}


def test_graph_export_and_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([(2, 1, 'a "b" & c'), (1, 0, None)], "asn long, hop int, name string")
    edges = spark.createDataFrame([(1, 2, None)], "u long, v long, weight long")
    write_gexf(nodes, edges, str(tmp_path / "g.gexf"))
    root = ET.parse(tmp_path / "g.gexf").getroot()
    assert [n.get("id") for n in root.iter("{http://gexf.net/1.3}node")] == ["1", "2"] and 'a "b" & c' in [a.get("value") for a in root.iter("{http://gexf.net/1.3}attvalue")]
    for kind in ("csv", "json", "parquet"):
        write_rows(nodes, str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == spark.read.json(str(tmp_path / "json")).count() == 2


def test_sql_functions(spark):
    assert "path_edges" in register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM path_edges('3 1 1 3')").collect()] == [(1, 3), (1, 3)]
    row = spark.sql("SELECT is_public_as(64512) a, is_public_as(3356) b, path_hops('') c, path_hops('1 2') d, path_origin('1 2') e, safe_ratio(1, 0) f, window_floor(timestamp'2025-07-01 00:07:09', 300) g").first()
    assert tuple(row) == (False, True, 0, 2, "2", 0.0, dt.datetime(2025, 7, 1, 0, 5))


def test_command_line(capsys, spark, data, tmp_path):
    assert main(["list"]) == 0 and "stat_view_full" in capsys.readouterr().out
    assert main(["run", "no_such", data, str(tmp_path)]) == 2
    assert main(["run", "label_shares", data, str(tmp_path), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "label_shares")).count() == 4


def test_runs_are_taken_up_where_they_ended(spark, tmp_path):
    rows = random_log(500, 12)
    log = topo.with_segment(update_log(spark.createDataFrame(rows, COLUMNS), 300)).cache()
    whole = {tuple(r) for r in stat_view(log, ["collector", "w"]).select("collector", "w", "total_updates", "new_prefixes", "dups").collect()}
    segments = sorted(r[0] for r in log.select("segment").distinct().collect())
    where = str(tmp_path / "run")
    for s in segments:
        out = resume_windows(log.filter(log.segment <= s), where)
    assert {tuple(r) for r in out.select("collector", "w", "total_updates", "new_prefixes", "dups").collect()} == whole
    again = resume_windows(log, where)  # nothing is left to do
    assert {tuple(r) for r in again.select("collector", "w", "total_updates", "new_prefixes", "dups").collect()} == whole
    warm = resume_windows(log, str(tmp_path / "warm"), from_segment=segments[1].strftime("%Y%m%d%H%M"))
    assert {tuple(r) for r in warm.select("collector", "w", "total_updates", "new_prefixes", "dups").collect()} == {x for x in whole if x[1] >= segments[1]}


def test_time_scoring(spark):
    got = time_scoring(lambda df: df.selectExpr("id + 1"), spark.range(50), 3, 2).collect()
    assert [(r.kind, r.n_rows) for r in got] == [("single", 1)] * 3 + [("batched", 50)] * 2 and all(r.ms > 0 for r in got)
