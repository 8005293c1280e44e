import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_subpackage(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "terraloom/llm", ignore_errors=True)
    shutil.rmtree(copy / "tests/llm", ignore_errors=True)
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    assert not [f for f in copy.rglob("*.py") if re.search(r"\bllm\b", f.read_text()) and f.name not in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py", "test_separation.py")]
