"""Readers and writers: document folders, triplet tables, HTML pages."""
