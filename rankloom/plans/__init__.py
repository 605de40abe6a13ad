"""Whole plans: the ranker and the queries."""
