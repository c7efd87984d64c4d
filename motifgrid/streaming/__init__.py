"""Streams of hits and letters: the batch operators applied to what arrives."""
