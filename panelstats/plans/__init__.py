"""Compositions: from person microdata to analysis tables."""
