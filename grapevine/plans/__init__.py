"""Whole analyses."""
