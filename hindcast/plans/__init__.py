"""Composite plans: rankers, feature frames and evaluation runs."""
