"""Operators for preparing training data at scale; ``queries`` registers one query for each."""
