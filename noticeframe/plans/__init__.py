"""Query parameters and whole query plans."""
