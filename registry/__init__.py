"""Binds every operator to the driver tables and states the same query in SQL."""
