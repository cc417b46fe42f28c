"""Readers and parsers: files, manifests, Markdown, YAML, PDF and diffs."""
