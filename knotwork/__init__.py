"""Knotwork: property-graph queries as DataFrame plans."""
