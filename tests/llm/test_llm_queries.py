"""Every query of the text operators on the smallest tables, against its SQL where it has one."""

import os

import duckdb
import pytest

from lakeloom.llm.queries import QUERIES, SQL
from lakeloom.llm.tokens import TOKENIZER

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents crawl_pages page_nodes pack_sizes mix_targets".split()


@pytest.mark.skipif(not os.path.isdir(DIR) or not os.path.exists(TOKENIZER), reason="no test tables or tokenizer here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in SQL:
        return
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    r = c.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(str(x[k]) for k in sorted(names)) for x in rows) == sorted(tuple(str(x[names.index(k)]) for k in sorted(names)) for x in r.fetchall())
