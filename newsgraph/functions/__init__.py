"""Column-level helpers (built-in expressions only)."""
