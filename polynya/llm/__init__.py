"""Operators of a training-data pipeline: score, join, search, sign, filter, extract, mix, pack, shard."""
