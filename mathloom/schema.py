"""Schemas of the tables that the engine reads and gives; parts it never fills itself included."""

from __future__ import annotations

POSITION = "STRUCT<x:INT,y:INT,width:INT,height:INT>"
FINDINGS = "ARRAY<STRUCT<type:STRING,message:STRING,position:INT,token_index:INT>>"
TOKENS = "ARRAY<STRUCT<type:STRING,value:STRING,position:INT,length:INT,metadata:MAP<STRING,STRING>>>"
NODES = "ARRAY<STRUCT<id:INT,parent:INT,role:STRING,ord:INT,depth:INT,type:STRING,value:STRING,name:STRING,position:INT,nested:BOOLEAN>>"

SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, source_file STRING",
    "formulas": f"doc_id BIGINT, ordinal INT, start INT, `end` INT, math_type STRING, latex STRING, raw STRING, confidence DOUBLE, page_number INT, position {POSITION}, mathml STRING",
    "chemicals": f"doc_id BIGINT, ordinal INT, text STRING, smiles STRING, inchi STRING, position {POSITION}, page_number INT, rendered_image BINARY, metadata MAP<STRING,STRING>",
    "code_blocks": f"doc_id BIGINT, ordinal INT, code STRING, language STRING, position {POSITION}, page_number INT, highlighted_html STRING, metadata MAP<STRING,STRING>",
    "diagrams": f"doc_id BIGINT, ordinal INT, diagram_type STRING, content STRING, position {POSITION}, page_number INT, rendered_image BINARY, metadata MAP<STRING,STRING>",
    "parsed": f"doc_id BIGINT, start INT, is_valid BOOLEAN, complexity_score DOUBLE, token_count INT, tree_depth INT, original_length INT, comment_count INT, has_macros BOOLEAN, tokens {TOKENS}, nodes {NODES}, errors {FINDINGS}, warnings {FINDINGS}",
    "results": f"source_file STRING, success BOOLEAN, errors {FINDINGS}, warnings {FINDINGS}, statistics STRUCT<total_formulas:INT,total_chemical_formulas:INT,total_code_blocks:INT,total_diagrams:INT,formula_types:MAP<STRING,INT>>, processing_time DOUBLE, ts TIMESTAMP",
    "ocr_results": "image_hash STRING, latex STRING, confidence DOUBLE, text STRING, mathml STRING, asciimath STRING, error STRING, backend STRING",
}
# The types of diagrams; stored ones differ in spelling.
DIAGRAM_TYPES = tuple("function_plot parametric_plot chemical_structure geometry flowchart graph other".split())
