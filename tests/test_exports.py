import duckdb
import pytest
from helpers import FOLDER

from mathloom.plans import queries
from mathloom.runtime import ship

EMPTY = {
    "latex": "\\documentclass{article}\n\\usepackage{amsmath}\n\\usepackage{amssymb}\n\\begin{document}\n\n\\section{Extracted Mathematical Content}\n\n\\end{document}",
    "markdown": "# Extracted STEM Content\n\nSource: %s\nProcessing time: n/a\n\n## Mathematical Formulas\n\n## Statistics\n\n- Total formulas: 0\n- Formula types: {}\n",
}


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("format", EMPTY)
def test_every_result_gets_a_document(spark, format):
    """Documents as the SQL has them, those without a formula without a section."""
    ship(spark)
    rows = queries.QUERIES[f"export_{format}"](spark, str(FOLDER)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    source = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    assert sorted(r.doc_id for r in rows) == sorted(source)
    wanted = dict(con.execute(queries.SQL[f"export_{format}"]).fetchall())
    assert {r.doc_id: r.document for r in rows} == wanted
    empty = [r for r in rows if r.document == EMPTY[format].replace("%s", source[r.doc_id] or "Unknown")]
    assert 0 < len(empty) < len(rows) and not any("ormula 1" in r.document for r in empty)
