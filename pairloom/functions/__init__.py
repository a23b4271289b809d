"""Column expressions: weights, observable masks, text and bounded numerics."""
