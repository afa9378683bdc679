"""Quarrymap: metadata search and corpus preparation as Spark plans."""
