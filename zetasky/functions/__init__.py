"""Scalar functions as pure Column expressions."""
