"""Operators for preparing training text: see registry.py for the queries."""
