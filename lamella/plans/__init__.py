"""The database over all of it, and the catalogue of queries with their SQL."""
