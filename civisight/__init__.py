"""Public-data analytics as Spark DataFrame operators."""
