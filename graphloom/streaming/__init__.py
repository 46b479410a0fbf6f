"""streaming of graphloom."""
