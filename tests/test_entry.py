"""The entry without the training-data package and the pipeline."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(folder, code):
    own = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # only the copy can be imported
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=own, capture_output=True, text=True, timeout=120)


def test_the_rest_works_alone(tmp_path):
    shutil.copytree(f"{ROOT}/docaudit", tmp_path / "docaudit", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    done = run(tmp_path, "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()), set(e.oracle_sql()) == set(e.queries()))")
    assert done.returncode == 0, done.stderr
    count, extra, same = done.stdout.split()
    assert int(count) > 100 and extra == "False" and same == "True"


def test_other_import_errors_are_told(tmp_path):
    shutil.copytree(f"{ROOT}/docaudit", tmp_path / "docaudit", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = run(tmp_path, "import __spark_entry__")
    assert done.returncode and "no_such_module" in done.stderr
