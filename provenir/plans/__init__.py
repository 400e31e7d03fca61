"""Operators composed into the tables a reader works with."""
