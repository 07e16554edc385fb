"""Gleaner operators."""
