"""Operators on training records and texts: overlap, packing, mixing, shared spans."""
