"""Training-data operators for large corpora; nothing else in the library imports this subpackage."""
