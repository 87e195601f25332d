"""Readers and writers of the tables' file forms."""
