"""Column and scalar functions that the operators share."""
