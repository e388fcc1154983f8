"""Queries: operators applied to tables, each with the SQL that gives the same rows."""
