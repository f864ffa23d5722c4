"""Chromatin-contact analytics on PySpark."""
