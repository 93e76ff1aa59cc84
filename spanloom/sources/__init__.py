"""Readers, mappers and writers at the edges."""
