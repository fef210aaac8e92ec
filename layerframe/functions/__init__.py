"""Column functions: maps, JSON documents and references."""
