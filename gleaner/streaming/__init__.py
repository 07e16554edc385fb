"""Gleaner streaming."""
