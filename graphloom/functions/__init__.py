"""Scalar functions and operators as column expressions."""
