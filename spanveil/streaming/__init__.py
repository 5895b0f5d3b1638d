"""Redaction of text as it arrives."""
