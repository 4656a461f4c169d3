import ast
import os
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "semloom").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("semloom.llm") for n in names), path


def test_the_rest_stands_alone(tmp_path):
    import shutil

    shutil.copytree(ROOT / "semloom", tmp_path / "semloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = (
        "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "assert all(q[n](s, '/root/testdata/sf0.001').count() for n in ('list_sorted', 'pattern_role_bearer', 'shacl_report')); s.stop()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})
