"""Registered queries of the library with the SQL that gives the same rows."""
