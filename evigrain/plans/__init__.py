"""Whole query plans, and the catalogue of registered queries."""
