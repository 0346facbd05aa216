import duckdb
import pytest

from brimwell.plans import picture_queries, queries, recording_queries, segment_queries, session_queries

SF = "/root/testdata/sf0.001"
PLANS = (queries, recording_queries, session_queries, picture_queries, segment_queries)
QUERIES = {n: f for p in PLANS for n, f in p.QUERIES.items()}
ORACLE_SQL = {n: f for p in PLANS for n, f in p.ORACLE_SQL.items()}


def rows(frame):
    return sorted(map(str, frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())
