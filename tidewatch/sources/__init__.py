"""Readers and writers for landed tables: fetches, sitemaps, robots files, versions."""
