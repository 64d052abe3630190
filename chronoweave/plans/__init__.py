"""Views over the star-schema tables, and the queries with their SQL."""
