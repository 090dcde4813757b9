from pathlib import Path

import pytest
from helpers import FOLDER, compare

from mathloom.plans import queries

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    rows = compare(spark, name, queries.QUERIES[name], queries.SQL.get(name))
    assert rows or name == "detect_equation"


def test_nothing_outside_imports_the_llm_package():
    package = Path(queries.__file__).parents[1]
    for path in package.rglob("*.py"):
        if "llm" not in path.relative_to(package).parts:
            assert "mathloom.llm" not in path.read_text(), path
