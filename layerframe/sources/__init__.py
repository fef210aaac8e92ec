"""Reading item trees, exclusive writes and shared working tables."""
