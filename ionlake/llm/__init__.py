"""Operations on text corpora for building training data.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; ``ionlake.llm.queries`` wires them to the driver tables.
"""
