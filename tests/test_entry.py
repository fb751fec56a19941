import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"] and df.count() == 50


def test_names():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_without_the_training_data_operators(tmp_path):
    """The rest imports when their folders and the pipeline are gone."""
    shutil.copytree(os.path.join(ROOT, "gridlark"), tmp_path / "gridlark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    said = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=60)
    n, oracles, found = out.stdout.split()
    assert int(n) == int(oracles) > 80 and found == "False"


@pytest.mark.parametrize("package", ["functions", "operators", "plans", "sources", "streaming"])
def test_nothing_else_imports_them(package):
    for folder, _, names in os.walk(os.path.join(ROOT, "gridlark", package)):
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"\bllm\b", f.read())


def test_a_missing_library_is_an_error(tmp_path):
    """Queries don't vanish because something that the operators need isn't installed."""
    shutil.copytree(os.path.join(ROOT, "gridlark"), tmp_path / "gridlark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "gridlark" / "llm").mkdir()
    (tmp_path / "gridlark" / "llm" / "__init__.py").write_text("import no_such_library\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=60)
    assert out.returncode and "no_such_library" in out.stderr
