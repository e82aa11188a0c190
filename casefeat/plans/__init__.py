"""Whole features and feature sets."""
