"""Readers and writers: CDX pages, redirect files, body stores, CSV exchange lists, pattern configuration."""
