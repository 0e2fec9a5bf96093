"""Whole plans built from operators."""
