"""Every query of the geospatial registry against its SQL; those without SQL must run."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import ROOT, canonical

from geoflow.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    mine, columns = canonical([tuple(r) for r in df.collect()], df.columns)
    done = duck.execute(registry.oracle_sql()[name])
    theirs, other = canonical(done.fetchall(), [c[0] for c in done.description])
    assert columns == other
    assert len(mine) == len(theirs)
    assert mine == theirs
    assert mine or name == "morph_open"  # opening leaves nothing of the smallest tables


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() >= (0 if name == "morph_open" else 1)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0


@pytest.mark.parametrize("gone", [["geoflow/llm", "tests/llm"], ["geoflow/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_stands_without_the_training_data_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or str(Path(folder, n).relative_to(ROOT)) in gone])
    said = "import __spark_entry__ as e; print(*sorted(e.queries()), sep='\\n'); assert e.oracle_sql().keys() <= e.queries().keys()"
    out = subprocess.run([sys.executable, "-c", said], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert out == sorted(registry.queries())
