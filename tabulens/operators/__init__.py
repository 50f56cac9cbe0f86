"""Table-level operators: every one takes a Spark DataFrame and returns one."""
