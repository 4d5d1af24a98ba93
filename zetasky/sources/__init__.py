"""Inputs and stores."""
