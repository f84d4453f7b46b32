"""Readers of the formats that catalogs come in, and writers of those that they go out in."""
