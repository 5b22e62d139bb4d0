import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "announcements" in df.columns


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_core_stands_without_the_llm_subpackage(tmp_path):
    code = "import sys; sys.modules['pathloom.llm'] = None\nimport __spark_entry__ as e\nassert 'stat_view_full' in e.queries() and 'p3_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_nothing_but_the_entry_names_the_llm_subpackage():
    for path in (REPO / "pathloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "pathloom.llm" not in path.read_text(), path


@pytest.mark.parametrize("name", ["p3_found", "p5_found", "p6_found", "p7_found"])
def test_found_columns(spark, data, name):
    columns = {"p3_found": ["collector", "asn", "window_id"], "p5_found": ["feature_id", "measure"], "p6_found": ["peer_as", "prefix"], "p7_found": ["pair", "stamp", "source", "target", "change"]}
    assert entry.queries()[name](spark, data).columns == columns[name]
