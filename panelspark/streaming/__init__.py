"""Streams of events in time windows."""
