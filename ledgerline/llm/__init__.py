"""Operations of a training-data pipeline on Spark: one module for each operator.

Nothing outside this subpackage imports it. ``registry`` holds the queries and
their SQL; ``__spark_entry__`` adds them when this subpackage can be imported.
"""
