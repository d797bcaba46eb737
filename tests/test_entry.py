"""The entry module: started elsewhere, or without the tokenizer files."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def python(code, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.strip().splitlines()[-1]


def test_queries_load_without_optional_packages(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
for name in ("public_tokenizers", "tokenizers", "xxhash"):
    sys.modules[name] = None
import __spark_entry__ as entry
names = entry.queries()
print(len(names), any(n.startswith("op") or n == "pipeline" for n in names), set(entry.oracle_sql()) <= set(names))
"""
    count, numbered, subset = python(code, tmp_path).split()
    assert int(count) > 130 and numbered == "False" and subset == "True"


def test_workers_import_the_package_from_another_folder(tmp_path):
    code = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", {str(ROOT / "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from titleq.session import build_session
spark = build_session("local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.showConsoleProgress": "false"}})
rows = entry.queries()["ml_itemsets_vertical"](spark, "/root/testdata/sf0.001").count()
print(rows)
spark.stop()
"""
    assert int(python(code, tmp_path)) > 0
