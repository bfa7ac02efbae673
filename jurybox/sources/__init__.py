"""Readers, line parsers, registries and sinks."""
