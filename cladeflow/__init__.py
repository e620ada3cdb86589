"""Taxonomy, vector and tree analytics written as Spark DataFrame programs."""
