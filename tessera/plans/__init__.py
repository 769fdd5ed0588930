"""Logical plans: grammar, parsing, binding, search, uncertainty, physical choice, compilation."""
