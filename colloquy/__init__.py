"""Colloquy: analytics over timed, multi-track conversations, written for Spark."""
