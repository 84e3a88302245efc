"""Queries by name, each with the SQL that gives the same rows."""
