"""Streams of samples into the grid and against stored models."""
