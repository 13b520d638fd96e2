"""Lodestone: document analytics, retrieval and corpus preparation on PySpark."""
