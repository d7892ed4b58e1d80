"""Operators for large text corpora; no other part of the package imports this one."""
