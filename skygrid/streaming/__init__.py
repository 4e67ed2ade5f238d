"""Continuous co-addition."""
