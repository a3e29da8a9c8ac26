"""Readers and writers: station files, the station list, saved tables."""
