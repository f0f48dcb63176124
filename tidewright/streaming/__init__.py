"""Structured Streaming: landing, drain and K-slack."""
