"""functions of the decision-data engine."""
