"""Scans: given tables, landed JSON, wire messages, dimensions, stand-ins."""
