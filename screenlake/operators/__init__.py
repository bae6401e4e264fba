"""Relational operators: statistics, evidence, sessions, mining, integrity, retrieval, certificates."""
