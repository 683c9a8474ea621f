"""Readers and writers: indicator files, lookups, catalogs, long-form stores."""
