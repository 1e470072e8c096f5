"""Operators of a training-data pipeline: deduplication, filters, decontamination, tokens, chats, archives."""
