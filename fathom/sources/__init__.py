"""Readers and writers: package feeds, listings, sidecars, dataset files, sinks."""
