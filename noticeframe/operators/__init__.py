"""DataFrame operators. Column names are arguments; nothing is collected unless a docstring says so."""
