"""Readers of listings and dimensions, and writers of exports and backups."""
