"""Column-level building blocks: scalar functions and predicates."""
