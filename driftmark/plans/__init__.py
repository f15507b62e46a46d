"""Registered queries: operators bound to the test tables, each with its checking SQL."""
