"""Registered queries with the SQL that must give the same rows."""
