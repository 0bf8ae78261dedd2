"""Queries a user asks: search, analytics, markets, scores."""
