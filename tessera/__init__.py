"""Tessera: a Spark-native engine for questions over mixed tables, text and vectors."""
