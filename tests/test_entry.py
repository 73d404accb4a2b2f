"""The driver entry with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, any(x.startswith('op1_') for x in q))"


@pytest.mark.parametrize("gone", [["panelwright/llm", "tests/llm"], ["panelwright/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_without_the_corpus_parts(tmp_path, gone):
    shutil.copytree(REPO / "panelwright", tmp_path / "panelwright", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path, ignore_errors=True)
        path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    _, pipeline, corpus = out.stdout.split()
    assert pipeline == str(corpus == "True" and "corpus_pipeline.py" not in gone)
