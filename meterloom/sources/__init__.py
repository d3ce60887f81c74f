"""Readers and writers: monthly meter files, the store, weather files, registry tables."""
