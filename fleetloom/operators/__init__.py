"""Batch operators over node, layer, document, log and event tables."""
