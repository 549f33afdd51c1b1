"""A PySpark engine for evidence integrity over text corpora."""
