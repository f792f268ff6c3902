"""Streaming of the posture engine."""
