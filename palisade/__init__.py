"""Spark jobs for untrusted telemetry captured as datagrams, and for corpus preparation."""
