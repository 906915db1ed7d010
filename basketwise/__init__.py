"""Spark-native analysis of shop behaviour logs, with corpus operators in ``llm``."""
