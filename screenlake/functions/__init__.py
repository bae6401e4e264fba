"""Column functions: text normal forms, decoders, pattern predicates, scores, signatures."""
