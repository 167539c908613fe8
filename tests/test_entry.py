import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from engramlake.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parent.parent


def same(spark, query, sql):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v
    df, rel = query(spark, str(DATA)), con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_core_does_not_import_the_training_data_operators():
    code = "import sys; import engramlake.queries; assert not [m for m in sys.modules if m.startswith('engramlake.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
