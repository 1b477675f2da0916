"""Pipeline definitions and query plans."""
