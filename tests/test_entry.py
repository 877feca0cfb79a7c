"""The driver contract on the smallest scale factor, checked against DuckDB."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from skinnyqr.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _norm(rows):
    def f(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(x + 0.0)
        return repr(x)

    return sorted(tuple(f(x) for x in r) for r in rows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"user_id", "item_id", "score", "rank"}
    assert df.count() > 0


def test_every_matrix_query_has_an_oracle():
    """The training-data queries have their own tests in tests/llm."""
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("hidden", ["skinnyqr.llm", "corpus_pipeline", "tokenizers", "public_tokenizers"])
def test_entry_without_an_optional_module(hidden):
    """The matrix queries are registered where the subpackage, the pipeline or a package only they need is absent."""
    code = (
        "import sys\n"
        "class Hide:\n"
        "    def find_spec(self, name, *_):\n"
        f"        if name == {hidden!r} or name.startswith({hidden!r} + '.'):\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Hide())\n"
        "import __spark_entry__ as E\n"
        "from skinnyqr.plans import QUERIES\n"
        "assert set(E.queries()) == set(QUERIES), set(E.queries()) ^ set(QUERIES)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(E.__file__)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = [tuple(r[c] for c in cols) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    theirs = [tuple(r[ocols.index(c)] for c in cols) for r in res.fetchall()]
    assert _norm(mine) == _norm(theirs)
