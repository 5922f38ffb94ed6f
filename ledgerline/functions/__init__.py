"""Column functions and fixed catalogues."""
