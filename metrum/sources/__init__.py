"""Readers and writers for session documents, libraries, jobs, sync state and file inventories."""
