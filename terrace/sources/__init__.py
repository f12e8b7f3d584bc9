"""Readers and writers: tables as arrays, and open file formats."""
