"""DataFrame operators: filters, joins, splits, rewrites, grading and statistics."""
