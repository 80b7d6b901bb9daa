"""Spark-first analytics over clause-structured documents."""
