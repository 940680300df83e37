import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_names_and_sql():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and {"p1_found", "p2_found", "p4_found", "p5_found"} <= set(e.queries())


def test_core_without_the_llm_package(tmp_path):
    """In a copy without the two llm folders the rest imports and gives the other queries."""
    for name in ("refweave", "__spark_entry__.py", "bench.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "refweave" / "llm", ignore_errors=True)
    code = "import importlib, pkgutil, refweave; [importlib.import_module(m.name) for m in pkgutil.walk_packages(refweave.__path__, 'refweave.')]; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p3_found' not in q and set(e.oracle_sql()) <= set(q), q; print(refweave.__path__)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, capture_output=True, text=True, env=env).stdout
    assert str(tmp_path) in out


@pytest.mark.skipif(not DATA.exists(), reason="needs the test data")
@pytest.mark.parametrize("name", ["p1_found", "p1_counts", "p2_profile", "p4_found", "p5_chains", "graph_edges", "innermost_position", "symbol_flatten", "kept_symbols", "unresolved_usages"])
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    theirs = con.execute(e.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    mine = e.queries()[name](spark, str(DATA))
    assert sorted(names) == sorted(mine.columns)
    order = [names.index(c) for c in mine.columns]
    assert sorted(map(str, (tuple(r) for r in mine.collect()))) == sorted(map(str, (tuple(r[k] for k in order) for r in theirs.fetchall())))
