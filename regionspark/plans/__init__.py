"""Whole queries: the library's operators applied to the driver's tables."""
