"""Gleaner functions."""
