"""Structured Streaming operators over arriving rollouts."""
