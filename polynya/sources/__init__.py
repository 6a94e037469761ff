"""Readers for text corpora and gridded arrays, and the sinks."""
