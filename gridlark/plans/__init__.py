"""Views over a table, their saved form, and the query catalogue."""
