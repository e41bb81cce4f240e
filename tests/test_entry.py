from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op1_') for k in q), set(e.oracle_sql()) <= set(q))"


def test_entry_without_the_subpackage(tmp_path):
    """The entry imports whether or not the subpackage of training-data operators and the pipeline are there."""
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm")
    for name, ignored in (("without", skip), ("no_pipeline", lambda d, names: {*skip(d, names), "corpus_pipeline.py"} & set(names))):
        shutil.copytree(ROOT, tmp_path / name, ignore=ignored)
        out = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path / name, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) > 70 and out[1:] == ["False", "False", "True"]
