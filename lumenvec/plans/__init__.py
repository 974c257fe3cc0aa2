"""Indexes: descriptors, parameters, building, searching, saving."""
