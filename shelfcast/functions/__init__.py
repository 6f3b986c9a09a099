"""Column helpers: safe arithmetic, series windows, ranking and distributed running totals."""
