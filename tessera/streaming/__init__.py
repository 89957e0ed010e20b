"""Linking a stream of new records against an index that stands."""
