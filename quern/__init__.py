"""Byte-corpus analytics on Spark: ordered corpus preparation, packing, chat and chunk analytics."""
