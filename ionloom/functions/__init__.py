"""Column expressions: masses, titles, chains and scores."""
