import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_optional_package(tmp_path):
    shutil.copytree(ROOT / "rostra", tmp_path / "rostra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'], q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, check=True)


def test_nothing_outside_imports_it():
    for path in (ROOT / "rostra").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "rostra.llm" not in path.read_text(), path
