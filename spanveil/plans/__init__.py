"""Whole jobs made of sources, operators and sinks."""
