"""Subpackage of lexiloom."""
