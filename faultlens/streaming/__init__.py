"""Structured Streaming: log tagging and watermarked window counts over a file source."""
