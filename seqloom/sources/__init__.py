"""Readers and writers for the domain text formats."""
