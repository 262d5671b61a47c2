"""Table access: logical tables, fixtures, readers and writers."""
