"""Column expressions, fixed values and the panel specification."""
