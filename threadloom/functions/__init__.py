"""Column builders: text, dates, predicates."""
