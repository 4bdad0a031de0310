"""Operators for preparing training text; each module holds one and its query."""
