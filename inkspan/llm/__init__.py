"""Operators for training-data pipelines: near copies, leaks, personal data, filters, tokens, chats."""
