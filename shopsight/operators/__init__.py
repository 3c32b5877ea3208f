"""Operators: each takes frames and parameters and gives back a lazy frame."""
