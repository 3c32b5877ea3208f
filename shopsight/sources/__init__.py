"""Readers and writers, and the retail view of the test tables."""
