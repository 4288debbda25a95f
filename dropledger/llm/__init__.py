"""Operations of a training-data pipeline, written for Spark.

Nothing else in the library imports this subpackage; ``catalog`` registers its
queries (``op1_…`` to ``op10_…`` and ``pipeline``).
"""
