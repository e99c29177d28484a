import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import digest  # noqa: E402
from mercato.sources.tables import TEST_TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["warehouse_cnpj", "uf_target", "brand", "sales_date", "ean", "sku", "quantity"]


def test_every_query_has_an_oracle():
    assert set(E.oracle_sql()) <= set(E.queries())
    # the corpus operators may have none; their own tests compare them with brute force
    from mercato.plans.registry import QUERIES
    assert set(QUERIES) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [c[0] for c in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_types_match_oracle(spark, duck, name):
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in E.queries()[name](spark, SF).schema.fields}
    rel = duck.sql(E.oracle_sql()[name])
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}


def test_without_the_corpus_subpackage(tmp_path):
    """Left out with its pipeline, the rest imports and keeps its queries; a broken import inside it is not hidden."""
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as E; print(len(E.queries()), 'sales_report' in E.queries())"

    def run(folder):
        return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)

    bare = tmp_path / "bare"
    shutil.copytree(os.path.join(root, "mercato"), bare / "mercato", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), bare)
    from mercato.plans.registry import QUERIES
    assert run(bare).stdout.split() == [str(len(QUERIES)), "True"]

    broken = tmp_path / "broken"
    shutil.copytree(bare, broken)
    (broken / "corpus_pipeline.py").write_text("import mercato.llm.nothing_there\n")
    os.makedirs(broken / "mercato" / "llm")
    (broken / "mercato" / "llm" / "__init__.py").write_text("")
    assert "nothing_there" in run(broken).stderr
