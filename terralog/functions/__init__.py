"""Scalar functions that Spark lacks, on Arrow batches."""
