"""Operators of the posture engine."""
