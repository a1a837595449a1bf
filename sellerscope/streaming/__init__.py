"""Structured Streaming: continuous scoring of seller metric records."""
