"""Readers and writers for cluster documents, layer files and rendered configs."""
