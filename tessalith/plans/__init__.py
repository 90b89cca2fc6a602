"""Registered queries, their SQL, and the fixture that both read."""
