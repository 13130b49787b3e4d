"""Provenance analytics over media files, expressed as Spark DataFrame operators."""
