"""Whole retrieval strategies and their comparison."""
