"""Recipes that several operators share: running values, task plans, resuming."""
