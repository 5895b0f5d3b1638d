"""Readers and writers: texts, corpora, results and type lists."""
