"""Readers: feature messages, obstacle files, NOTAM text, area lists, grids, delivered files."""
