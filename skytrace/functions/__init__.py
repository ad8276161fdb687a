"""Skytrace subpackage."""
