"""Operators for preparing language-model training data, and the queries that apply them.

``QUERIES`` maps a query name to ``(spark, sf_dir) -> DataFrame`` and ``ORACLE_SQL`` a query name to
DuckDB SQL; nothing outside this package imports it except the guarded block in ``__spark_entry__.py``.
"""
