"""Retail price intelligence expressed as Spark plans."""
