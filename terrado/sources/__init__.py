"""Readers and writers: tables, catalogs, spreadsheets, pages."""
