"""Readers, writers, generators and column metadata."""
