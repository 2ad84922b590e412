"""Whole analysis plans assembled from the operators."""
