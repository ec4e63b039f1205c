"""Column builders: contract keys, identifiers, predicates. All are built-in expressions, so they stay in generated code."""
