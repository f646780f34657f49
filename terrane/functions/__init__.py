"""Column functions: predicates, scalar rules, geometry."""
