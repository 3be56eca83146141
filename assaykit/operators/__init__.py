"""DataFrame operators: scoring, combining, perturbing and evaluating."""
