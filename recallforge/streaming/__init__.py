"""Structured Streaming: session buffers, recall feedback, events, trackers."""
