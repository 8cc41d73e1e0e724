"""Fitted studies on streaming frames."""
