"""Tidewire: a news analytics and retrieval engine written as Spark plans."""
