"""Registered queries: operators applied to the given tables, each beside its SQL twin."""
