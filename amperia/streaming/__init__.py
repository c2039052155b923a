"""The same pairing as a stream."""
