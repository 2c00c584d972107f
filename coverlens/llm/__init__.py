"""Operators for training data: files of token ids, near copies, filters, masking, packing, chat text."""
