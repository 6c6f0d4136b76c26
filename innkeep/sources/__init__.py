"""Typed sources and sinks of the bookings tables."""
