"""The library works where the training-data operators, or the libraries that only they need, are missing."""

import os
import shutil
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = textwrap.dedent("""
    import pkgutil, importlib, sys
    import __spark_entry__ as entry, tablescope
    names = set(entry.queries())
    assert len(names) >= 60 and not any(n.startswith("op") and n[2].isdigit() for n in names - {"outliers"}), names
    assert "pipeline" not in names and set(entry.oracle_sql()) <= names
    for m in pkgutil.walk_packages(tablescope.__path__, "tablescope."):
        if not m.name.endswith("__main__"):
            importlib.import_module(m.name)
    print("fine")
""")


def run(folder, before=""):
    return subprocess.run([sys.executable, "-c", before + LOOK], cwd=folder, env={**os.environ, "PYTHONPATH": folder}, capture_output=True, text=True, timeout=120)


def copy_without(folder, *left_out):
    ignore = shutil.ignore_patterns("__pycache__", *left_out)
    shutil.copytree(os.path.join(ROOT, "tablescope"), os.path.join(folder, "tablescope"), ignore=ignore)
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), folder)


def test_without_the_subpackage_and_the_pipeline(tmp_path):
    copy_without(tmp_path, "llm")
    out = run(str(tmp_path))
    assert out.stdout.strip() == "fine", out.stderr


def test_with_the_pipeline_file_left_behind(tmp_path):
    copy_without(tmp_path, "llm")
    (tmp_path / "corpus_pipeline.py").write_text("from tablescope.llm.common import load\n")
    out = run(str(tmp_path))
    assert out.stdout.strip() == "fine", out.stderr
