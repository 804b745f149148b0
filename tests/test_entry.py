import duckdb
import pytest

import __spark_entry__ as entry
from mailquarry.plans import registry

D = "/root/testdata/sf0.001"
SAMPLE = sorted(registry.SQL)


def canon(rows):
    def cell(v):
        return repr(round(v, 9) + 0.0) if isinstance(v, float) else v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else repr(v)

    return sorted("|".join(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    import glob
    import os

    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = entry.queries()[name](spark, D)
    columns = sorted(df.columns)
    have = df.select(*columns).toArrow().to_pydict()
    result = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == columns
    assert canon(zip(*(have[c] for c in columns))) == canon([tuple(r[i] for i in order) for r in result.fetchall()])


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "rank", "more"]
