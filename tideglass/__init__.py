"""Tideglass: a PySpark-native engine for the analytics behind monitoring web pages."""
