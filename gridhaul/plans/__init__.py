"""Whole queries and the tables that they read."""
