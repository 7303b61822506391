"""Functions of values and of groups."""
