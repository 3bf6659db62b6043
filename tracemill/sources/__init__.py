"""Readers and writers for trace, probe and log files."""
