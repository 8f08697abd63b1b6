"""Readers, scans and the change-only writer."""
