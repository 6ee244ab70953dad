"""Continuous operation: an extension, not a counterpart of anything batch."""
