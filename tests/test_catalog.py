"""Every query of the catalog against its SQL twin."""

import duckdb
import pytest

from loomgraph import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    made = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == cols
    assert got == sorted(str([plain(r[names.index(c)]) for c in cols]) for r in made.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).take(1)


def test_secrets_as_sql_reads_them(spark, tmp_path):
    """Other letter case, other lengths, words that end in token, and an id that two rows have."""
    h = "0123456789abcdef0123456789abcdef01234567"
    texts = [f'token = "{h}" token = "{h}"', f'TOKEN = "{h.upper()}"', f'Token = "{h}"', f'mytoken = "{h}"', f'token = "{h[:32]}"', f'token: "{h}"', f"token = '{h}'", None, "", f'x token = "{h}"']
    spark.createDataFrame([(i % 9, x) for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalog.queries()["r12_secrets"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got) == sorted(con.execute(catalog.oracle_sql()["r12_secrets"]).fetchall())
