"""Session, tables and the registry of queries."""
