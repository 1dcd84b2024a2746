"""The entry module, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("kilnflow.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(k.startswith("op") or k == "pipeline" for k in e.queries() if k != "operating_point"))
"""


def test_imports_without_the_subpackage():
    out = subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 50 and int(out[1]) > 40 and out[2] == "False"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"feature", "rank", "confidence"} <= set(rows[0].asDict())
