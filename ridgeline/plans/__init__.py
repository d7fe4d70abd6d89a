"""Whole jobs and the SQL surface."""
