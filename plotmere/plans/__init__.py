"""Fixed tables, and the plans that chain operators."""
