"""plans of graphloom."""
