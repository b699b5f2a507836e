"""Recipes: recorded steps that can be replayed."""
