"""Column expressions: single-precision metrics, predicates, and z-order keys."""
