"""Correction of read streams with a fixed model."""
