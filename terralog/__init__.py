"""Climate-series, evidence and decision analytics as Spark DataFrame operators."""
