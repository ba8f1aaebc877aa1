"""kilnbase: a PySpark-native analytics engine for building knowledge bases.

Everything is declared with the DataFrame and SQL APIs; see README.md for the map of
subpackages. `kilnbase.llm` holds the training-data operators and is imported by nothing else
in the library.
"""
