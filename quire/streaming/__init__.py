"""Structured Streaming twins of the stateful operators (ST-1 .. ST-6).

Each stream has a batch twin that defines correctness; tests feed the same
rows as several files through ``trigger(availableNow=True)`` and compare.
"""
