"""Sequence and genomic-interval analytics as Spark DataFrame operators."""
