"""Tessera: event analytics as declarative Spark plans."""
