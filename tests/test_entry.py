"""The entry survives a missing text part, and nothing else."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError("no " + name, name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
print(len(entry.queries()), any(n.startswith("op") or n == "pipeline" for n in entry.queries() | entry.oracle_sql()))
"""


@pytest.mark.parametrize("name", ["leadloom.llm", "corpus_pipeline", "public_tokenizers", "regex", "xxhash"])
def test_without_the_text_part(name):
    done = subprocess.run([sys.executable, "-c", CODE.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    count, text_part = done.stdout.split()
    assert int(count) > 130 and text_part == "False"


def test_a_broken_library_is_not_hidden():
    done = subprocess.run([sys.executable, "-c", CODE.format(name="leadloom.sources")], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "no leadloom.sources" in done.stderr
