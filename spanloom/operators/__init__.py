"""Relational operators over versioned trace tables."""
