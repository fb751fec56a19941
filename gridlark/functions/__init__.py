"""Column helpers: names and letters, numbers, dates, and order over a whole table."""
