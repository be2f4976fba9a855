"""Column functions: no joins, no actions, only expressions."""
