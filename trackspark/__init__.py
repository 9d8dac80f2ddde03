"""Spark jobs for keyed, frame-indexed signals."""
