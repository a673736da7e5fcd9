"""Scalar functions with the semantics of path programs."""
