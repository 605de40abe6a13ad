"""Readers of datasets, the catalogue of models, and encoders."""
