"""Watchlist analytics as lazy DataFrame plans."""
