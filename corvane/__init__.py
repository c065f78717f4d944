"""A PySpark engine for searching and analysing corpora of code and documents."""
