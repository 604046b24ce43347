"""Tracewell: a PySpark-native engine for linked documents, code references and typed records."""
