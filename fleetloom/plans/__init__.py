"""Bindings of the given tables to the fleet model, and the registered queries with their SQL twins."""
