"""Column builders: rounding, cleaning, metrics, predicates."""
