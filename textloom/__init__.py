"""textloom: a Spark-native text and opinion analytics engine.

Every operator takes and returns DataFrames or Columns; Catalyst picks the
physical plan.  The optional subpackage ``textloom.llm`` (training-data
pipeline operators) is not imported by anything else in this package.
"""

__version__ = "0.1.0"
