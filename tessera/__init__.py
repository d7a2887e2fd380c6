"""Retrieval analytics over document and source-code corpora on the PySpark DataFrame API."""
