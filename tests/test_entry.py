"""The entry module with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e


def test_names():
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 40


def test_without_corpus_operators():
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('statloom.llm'):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert len(e.queries()) > 40 and not any(x.startswith('op') or x == 'pipeline' for x in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)


def test_entry(spark):
    assert e.entry(spark).count() == 60
