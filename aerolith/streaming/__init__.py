"""Deliveries arriving in a folder, as Structured Streaming."""
