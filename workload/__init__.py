"""Queries that exercise every operator on the given tables, with oracle SQL beside them."""
