"""Training-data operators: sharding, chat rendering, quality, mixing, LM scoring, dedup, language ID, token files, decontamination."""
