"""Readers and writers: tables, exclusion lists, column contracts and reply texts."""
