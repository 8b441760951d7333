"""Readers, axis builders, sinks and seeded generators."""
