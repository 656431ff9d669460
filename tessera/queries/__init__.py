"""Operators bound to the landed tables, each with the SQL it must agree with."""
