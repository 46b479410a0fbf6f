"""sources of graphloom."""
