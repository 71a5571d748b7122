"""Resumable page streams."""
