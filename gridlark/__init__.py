"""Gridlark: exploratory table analytics as Spark DataFrame operators."""
