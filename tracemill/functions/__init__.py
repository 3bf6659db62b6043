"""Column expressions: each takes Columns and returns a Column, so they fuse into one stage."""
