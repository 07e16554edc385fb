"""Gleaner plans."""
