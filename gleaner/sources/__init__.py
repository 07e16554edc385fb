"""Gleaner sources."""
