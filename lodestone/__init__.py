"""Retrieval and data processing over document collections, expressed as PySpark DataFrame plans."""
