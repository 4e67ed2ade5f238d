"""Readers and writers: FITS, PNG, tile tables and properties files."""
