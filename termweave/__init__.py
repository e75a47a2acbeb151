"""Spark-first text retrieval, entity linking and corpus analytics."""
