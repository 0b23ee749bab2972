"""A Spark-first analytics engine: every table is a view derived from an immutable, ordered log."""
