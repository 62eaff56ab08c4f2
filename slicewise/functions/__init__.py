"""Column expressions and identifier helpers."""
