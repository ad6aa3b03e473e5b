"""Column builders of the expression language."""
