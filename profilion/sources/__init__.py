"""Readers and writers: logged instrument messages, gridded text, and the store of time buckets."""
