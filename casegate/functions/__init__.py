"""Column functions. Everything here is a built-in expression; no UDFs."""
