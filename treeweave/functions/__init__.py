"""Column functions used in preparing workloads."""
