"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import math
import shutil
import subprocess
import sys

import pytest

from skytrace import plans
from tests.conftest import DATA, ROOT


def rows(names, found):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", plans.SQL)
def test_matches_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, DATA), duck.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    found = got.collect()
    assert found and rows(got.columns, found) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n not in plans.SQL])
def test_runs(spark, name):
    found = plans.QUERIES[name](spark, DATA)
    assert found.count() > 0 and found.where("flight_id is null").count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 26
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_stands_without_llm(tmp_path):
    """With the llm folders gone, and with the pipeline's file gone or not, the entry imports and names all other queries."""
    shutil.copytree(ROOT / "skytrace", tmp_path / "skytrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'op1_mix' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
        assert done.returncode == 0 and int(done.stdout) == len(plans.QUERIES), done.stderr
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
