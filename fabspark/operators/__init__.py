"""Operators: lazy DataFrame transformations."""
