"""Readers, writers and the inventory-shaped views over the given tables."""
