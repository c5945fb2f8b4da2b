"""Column functions: pure expressions that Catalyst sees through."""
