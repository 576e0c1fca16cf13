"""Registered queries with their SQL, and the fixtures they start from."""
