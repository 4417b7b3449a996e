"""Streaming ingestion of specimens (an extension beyond batch studies)."""
