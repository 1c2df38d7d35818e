"""Readers: files and archives, office documents, registries, tables."""
