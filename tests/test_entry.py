import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "constant_sites" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_pipeline(tmp_path):
    for name in ("__spark_entry__.py", "dendrolake"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name) if source.is_dir() else shutil.copy(source, tmp_path / name)
    shutil.rmtree(tmp_path / "dendrolake/llm", ignore_errors=True)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'violations' in q and not [x for x in q if x.startswith('op') and x[2].isdigit()]; print(len(q), len(e.oracle_sql()))"],
        cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True,
    )
    assert said.returncode == 0, said.stderr


def test_nothing_outside_imports_the_pipeline_package():
    for f in (ROOT / "dendrolake").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
