"""Readers and writers. Every reader returns a lazy DataFrame with an explicit schema."""
