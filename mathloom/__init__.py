"""mathloom: a PySpark-native engine for mathematical content in large text collections.

Formulas are detected in text as typed rows, parsed into tokens, a node table and
findings, scored, normalised, converted to MathML, aggregated and exported.  Everything
is a lazy DataFrame plan; Python runs only in Arrow batches and only where the grammar
needs state.
"""

__version__ = "0.1.0"
