"""Column expressions: elementwise arithmetic, comparison, logic, complex numbers, activations and polynomials."""
