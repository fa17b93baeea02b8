import pytest

from foliomill.llm import entry
from tests.conftest import DATA

COLUMNS = {
    "p1_found": ["layer_id", "kind"], "p2_found": ["id_a", "id_b"], "p3_found": ["layer_id", "line_no", "kind"], "p4_found": ["chunk_id", "sent_start"], "p5_found": ["article_id", "page_number", "language"],
    "p6_found": ["id_a", "id_b"], "p7_found": ["article_id", "chunk_index"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "subject"],
}


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, str(DATA))
    rows = df.count()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and df.distinct().count() == rows if name != "p8_ids" else df.columns == COLUMNS[name]
    assert rows >= 0


def test_pages_are_repaired_too(spark):
    got = {r.source: r["count"] for r in entry.p3_repaired(spark, str(DATA)).groupBy("source").count().collect()}
    assert got == {"layers": spark.read.parquet(f"{DATA}/page_text_layers.parquet").count(), "pages": spark.read.parquet(f"{DATA}/pages.parquet").count()}
