"""Tabular files as lazily evaluated, searchable, sortable views on Spark."""
