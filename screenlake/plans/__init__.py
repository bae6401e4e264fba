"""Query plans: compositions of operators over the tables."""
