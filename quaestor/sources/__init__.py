"""Readers: snapshots, saved result pages, RDF and feed XML, linked data."""
