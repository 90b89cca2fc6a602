"""Readers of manifests, transcript caches, word lists, archives and sound files."""
