"""Auction-price and collection analytics as DataFrame transforms for Spark."""
