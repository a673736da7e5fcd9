"""Lets tests import the package from the root."""
