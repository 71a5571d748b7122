"""Registered queries, each with the SQL that tells its result."""
