"""Readers: snapshots, JSON pages, HTML, spreadsheets, documents, archives, calendars."""
