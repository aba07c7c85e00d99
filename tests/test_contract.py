"""The driver's contract: the rest works with the subpackage for training text and its pipeline taken away."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent
PROGRAM = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def test_rest_without_training_text(tmp_path):
    import json

    import __spark_entry__

    skip = shutil.ignore_patterns(".git", "__pycache__", "llm")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    for removed in (False, True):
        if removed:
            (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
        out = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr
        found, sql = json.loads(out.stdout.strip().splitlines()[-1])
        assert "pipeline" not in found and not [n for n in found if n.startswith("op")]
        assert set(sql) <= set(found) == {n for n in __spark_entry__.queries() if n != "pipeline" and not n.startswith("op")}
