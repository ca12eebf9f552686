"""Alerts and command logs as streams."""
