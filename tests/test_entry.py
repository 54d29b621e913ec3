from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as E
from continuity.workload.oracles import ORACLES
from continuity.workload.queries import QUERIES
from tests.helpers import plan

SF_DIR = "/root/testdata/sf0.001"
# Queries whose plan can be looked at without copying or streaming anything.
LAZY = sorted(
    name
    for name in QUERIES
    if not re.match("csv_|append_|stream_|ingest_|replicate_|sync_|schemas_created|inventory_(catalogs|schemas)", name)
)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["l_orderkey", "l_linenumber", "delay_type", "source_table"]
    assert df.count() > 0


def test_same_keys():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())
    # Names of the optional subpackage are its own.
    assert not [n for n in QUERIES if "pipeline" in n or re.match(r"op\d", n)]


def test_nothing_needs_the_optional_subpackage():
    root = Path(E.__file__).parent
    code = "import sys; sys.modules['continuity.llm'] = None; import __spark_entry__ as E; print(*sorted(E.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert done.stdout.split() == sorted(QUERIES)
    users = [p for p in (root / "continuity").rglob("*.py") if "continuity.llm" in p.read_text() and "llm" not in p.parts]
    assert not users


@pytest.mark.parametrize("name", LAZY)
def test_plans_stay_in_the_jvm(spark, name):
    text = plan(E.queries()[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "NestedLoopJoin", "PythonUDF", "ArrowEval", "BatchEval", "MapInPandas"):
        assert operator not in text
