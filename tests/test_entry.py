"""The entry points, with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

from pagemill.session import work_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(folder, code):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)


def _copy(target, *left_out):
    ignored = shutil.ignore_patterns(".git", "__pycache__", "*.json", *left_out)
    shutil.copytree(ROOT, target, ignore=ignored)
    return str(target)


def test_queries_without_the_document_operators(tmp_path):
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [q for q in e.queries() if q.startswith('op')])"
    for k, left_out in enumerate((("llm", "corpus_pipeline.py"), ("llm",), ("corpus_pipeline.py",))):
        done = _run(_copy(tmp_path / str(k), *left_out), code)
        assert done.returncode == 0, done.stderr
        assert int(done.stdout.split()[0]) > 100
        if "llm" in left_out:
            assert done.stdout.strip().endswith("[]")


def test_other_missing_modules_are_errors(tmp_path):
    folder = _copy(tmp_path / "broken", "llm")
    with open(os.path.join(folder, "corpus_pipeline.py"), "w") as file:
        file.write("import no_such_module_at_all\n")
    done = _run(folder, "import __spark_entry__ as e; e.queries()")
    assert done.returncode != 0 and "no_such_module_at_all" in done.stderr


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    """A session whose site names no shared folder."""

    def __init__(self, master):
        self.sparkContext, self.conf = _Context(master), {}


def test_without_a_shared_folder_only_one_machine_gets_its_own():
    local = _Session("local[4]")
    first, second = work_folder(local, "x"), work_folder(local, "x")
    assert first != second and os.path.dirname(first) == os.path.dirname(second) == local.sparkContext.folder
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            work_folder(_Session(master), "x")
