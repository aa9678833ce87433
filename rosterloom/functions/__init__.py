"""Subpackage of rosterloom."""
