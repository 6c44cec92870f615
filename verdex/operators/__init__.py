"""operators of the decision-data engine."""
