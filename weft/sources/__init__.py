"""File corpora and report sinks."""
