"""Column, window and join helpers."""
