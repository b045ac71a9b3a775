"""Search-trajectory analytics on Spark: sources, column functions, operators, plans and streams."""
