"""Table operators, one module per concern."""
