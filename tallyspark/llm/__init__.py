"""Training-data operators: mixing, language id, tokenisation, chat format, quality, dedup, search."""
