"""Spark jobs for stored web pages: page facts, findings, link graphs, reports and archives."""
