"""Ready queries and their SQL statements."""
