"""Operators for preparing training text: mixing, packing, filtering, matching, archives and threads."""
