"""Sinks: wire JSON (K1 K5), history (K2), latest state (K3), alerts (K7)."""
