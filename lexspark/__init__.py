"""Statute and public-programme corpus analytics as plain Spark DataFrame transformations."""
