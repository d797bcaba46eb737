"""Readers and writers. Every reader takes a fixed schema."""
