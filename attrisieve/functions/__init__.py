"""Column functions the operators are built of."""
