"""The driver's entry points, with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(where) -> set[str]:
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=where, capture_output=True, text=True, check=True).stdout
    return set(out.rpartition("NAMES")[2].split())


def test_queries_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "tallyfold", tmp_path / "tallyfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    bare = names(tmp_path)
    assert len(bare) > 200 and not any(n.startswith("op") or n == "pipeline" for n in bare)
    assert bare <= names(ROOT)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["universe", "ticker", "value", "rank", "mean", "median", "vs_median_pct"] and df.count() > 0
