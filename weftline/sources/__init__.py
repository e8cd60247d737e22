"""Readers and writers of the formats that recordings come in."""
