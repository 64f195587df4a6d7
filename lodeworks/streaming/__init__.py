"""Structured Streaming: file-drop ingest, event windows and session state."""
