"""Ocean profile analytics as Spark DataFrame operators."""
