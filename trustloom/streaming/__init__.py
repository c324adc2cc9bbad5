"""Streams of events and records."""
