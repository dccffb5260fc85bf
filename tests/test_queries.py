"""Every query of the core against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from lakeloom import queries as core

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings crawl_pages page_nodes snapshots watch_events pack_sizes mix_targets".split()


def plain(v):
    return f"{float(v):.9g}" if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, name):
    df = core.QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in core.SQL:
        return
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    r = c.execute(core.SQL[name])
    names = [x[0] for x in r.description]
    want = sorted(tuple(plain(x[names.index(k)]) for k in sorted(names)) for x in r.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(plain(x[k]) for k in sorted(df.columns)) for x in rows) == want
