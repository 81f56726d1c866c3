"""Training-data operators: media, near-dedup, classifiers, mixing, chat, WARC, sharding, tokens."""
