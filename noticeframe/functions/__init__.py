"""Column functions: time, text and fact rules. All are built-in expressions unless a docstring says otherwise."""
