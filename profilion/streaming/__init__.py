"""Streams into the store, and operators that keep state between micro-batches."""
