"""Seshat: retrieval, evaluation and corpus analytics as Spark DataFrame operators."""
