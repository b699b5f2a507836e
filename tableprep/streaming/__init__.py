"""Recipes on files as they arrive."""
