"""Quartzite: a strictly typed SQL dialect, constraints, transactions and time travel on PySpark."""
