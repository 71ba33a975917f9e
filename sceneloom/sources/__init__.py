"""Readers and writers: JSON lines, JSON documents, raw bytes, marked-up plays, text reports."""
