"""Readers and writers for the file formats of an evaluation."""
