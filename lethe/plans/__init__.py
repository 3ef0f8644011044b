"""Registered queries: operators applied to stand-in views of the driver tables."""
