"""The driver's functions, with and without the llm folder."""

import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_entry_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "roadloom"):
        (tmp_path / name).symlink_to(HERE / name)
    code = "import sys; sys.modules['roadloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'map_report' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
