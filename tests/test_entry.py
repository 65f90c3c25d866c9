import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark, small):
    import __spark_entry__ as entry

    out = entry.queries()["bm25_smoothed_topk"](spark, small)
    assert out.columns == ["query_id", "doc_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_imports_without_the_subpackage(tmp_path, pipeline):
    """Without both, and without the subpackage alone."""
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])):
        os.symlink(ROOT / name, tmp_path / name)
    package = tmp_path / "talweg"
    package.mkdir()
    for x in (ROOT / "talweg").iterdir():
        if x.name != "llm":
            os.symlink(x, package / x.name)
    code = "import __spark_entry__ as e; assert 'bm25_smoothed_topk' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
