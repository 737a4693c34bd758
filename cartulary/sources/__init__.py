"""Readers for catalogs, assets and archives."""
