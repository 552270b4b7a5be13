"""Registered queries and flows over files."""
