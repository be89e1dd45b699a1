"""Curves and models on NumPy arrays, for use in grouped pandas functions and on small samples."""
