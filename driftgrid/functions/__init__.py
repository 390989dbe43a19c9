"""Column functions: attribute maps, arrays, times."""
