"""Dictionaries, archives and the catalog of them."""
