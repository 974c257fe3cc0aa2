"""Sparse matrix files and the fixture corpora."""
