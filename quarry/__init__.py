"""Codebase and corpus analytics expressed as Spark DataFrame operators."""
