"""Readers for the exchange formats."""
