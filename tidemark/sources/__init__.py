"""Readers, writers and manifests of files."""
