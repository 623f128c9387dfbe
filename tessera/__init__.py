"""Spark-native engine for tabular and workbook data."""
