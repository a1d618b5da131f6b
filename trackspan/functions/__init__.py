"""Column functions: in, Column; out, Column."""
