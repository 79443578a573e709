"""The entry module without the optional subpackage or what it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
BLOCK = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {name!r} or name == {name!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Blocked())
sys.path.insert(0, {repo!r})
import __spark_entry__ as E
names = set(E.queries())
assert not any(n.startswith("op") or n == "pipeline" for n in names) and set(E.oracle_sql()) <= names
print(len(names))
"""


@pytest.mark.parametrize("missing", ["lendscope.llm", "xxhash"])
def test_core_queries_without_the_subpackage(missing):
    import __spark_entry__ as E

    core = [n for n in E.queries() if not n.startswith("op") and n != "pipeline"]
    run = subprocess.run([sys.executable, "-c", BLOCK.format(name=missing, repo=str(REPO))], capture_output=True, text=True, cwd="/")
    assert run.returncode == 0, run.stderr
    assert int(run.stdout.split()[-1]) == len(core) >= 60
