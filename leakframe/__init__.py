"""Secret-exposure analytics on Spark DataFrames.

Everything public takes and returns DataFrames (or Columns), so operators chain
with ``df.transform(...)`` and Catalyst sees one plan.
"""
