"""Training-data operators: language, quality, near-duplicates, secrets, tokens, packing, archives, chat, vectors."""
