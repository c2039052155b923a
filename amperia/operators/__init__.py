"""Relational building blocks: version lookups, pairing of events, generated keys, changes to tables."""
