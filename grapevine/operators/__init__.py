"""Operators: plain functions from frames to frames."""
