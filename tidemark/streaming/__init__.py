"""Stateful streams: the per-origin limiter and deliveries."""
