import duckdb
import pytest

from lexweave.llm import queries
from lexweave.llm.oracles import DECONTAMINATE, JACCARD

SF = "/root/testdata/sf0.001"


def _equal(spark, name, sql, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'" if folder != SF else f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    got, want = (sorted(map(tuple, x)) for x in (got.select(names).collect(), want.fetchall()))
    assert got == want
    return got


@pytest.mark.parametrize("name, sql", [("op5_decontaminate", DECONTAMINATE), ("op7_jaccard_join", JACCARD)])
def test_equals_sql_on_the_tables(spark, name, sql):
    assert len(_equal(spark, name, sql, SF)) == 200


@pytest.mark.parametrize("name, sql", [("op5_decontaminate", DECONTAMINATE), ("op7_jaccard_join", JACCARD)])
def test_equals_sql_on_hard_rows(spark, tmp_path, name, sql):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(1, long), (2, long.upper()), (3, long + " tail"), (4, None), (5, ""), (6, "one two"), (7, "ONE two"), (8, "one two three four"), (9, "Só é isto\tfim"), (10, "x " * 500 + "one two x " + long), (11, "a-b c")]
    items = [(1, long[:60]), (2, "one two"), (3, ""), (4, None), (5, " ".join(f"w{i}" for i in range(20, 40)).title()), (6, "A b"), (7, "one two")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    _equal(spark, name, sql, str(tmp_path))
