"""Readers and writers: corpus files, JSON records, archives, snapshots."""
