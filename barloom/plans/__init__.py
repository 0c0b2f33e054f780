"""Registered queries with the SQL each one is checked against."""

from barloom.plans.registry import load_all

__all__ = ["load_all"]
