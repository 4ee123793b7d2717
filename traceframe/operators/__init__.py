"""Relational operators over event, asset and request DataFrames."""
