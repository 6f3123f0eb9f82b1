"""Functions of the analytics engine."""
