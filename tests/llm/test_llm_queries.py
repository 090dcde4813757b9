import pytest
from helpers import FOLDER, compare

from mathloom.llm import queries

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
COLUMNS = {
    "p1_found": {"formula_id", "field_name"},
    "p2_found": {"field_name", "item"},
    "p4_found": {"table_name", "first_id", "copy_id"},
    "p5_found": {"field_name", "term", "mark"},
    "p6_found": {"doc_id", "item_id"},
    "p8_found": {"doc_id"},
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    rows = compare(spark, name, queries.QUERIES[name], queries.SQL.get(name))
    assert len(rows) == len(set(rows))
    assert rows or name == "p4_collisions"
    if name in COLUMNS:
        assert set(rows[0].asDict()) == COLUMNS[name]
