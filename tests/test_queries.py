import ast
from pathlib import Path

import duckdb
import pytest

from foliomill.plans import catalog
from tests.conftest import DATA

ROOT = Path(__file__).resolve().parents[1]
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()

    def order(rows):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])

    assert order(got) == order(want)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(NAMES)))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, str(DATA)).count() > 0


def test_core_does_not_know_the_subpackage():
    for path in (ROOT / "foliomill").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "foliomill").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
