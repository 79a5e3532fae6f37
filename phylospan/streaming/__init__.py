"""Continuous classification of arriving reads."""
