"""Readers of driver tables and point files."""
