"""Document translation analytics as Spark DataFrame operators."""
