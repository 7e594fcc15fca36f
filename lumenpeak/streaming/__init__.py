"""Batch operators on arriving data."""
