"""Readers and writers for the file formats the engine takes and gives."""
