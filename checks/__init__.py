"""Queries on the shared test tables and the SQL they are compared with."""
