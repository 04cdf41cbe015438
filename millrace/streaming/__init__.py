"""Structured Streaming form of the stateless stages."""
