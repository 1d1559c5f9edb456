"""Loomstone: a PySpark-native engine for building and auditing symbolic reasoning corpora."""
