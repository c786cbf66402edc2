"""Readers of files and pages, and writers of derived indexes."""
