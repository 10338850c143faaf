"""Statements that change rows, with their constraint checks as joins and aggregates."""
