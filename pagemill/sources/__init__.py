"""Readers and writers of page text and records."""
