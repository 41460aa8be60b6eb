"""Training-data operators: packing, chat windows, licence scans, mixing, extraction, search, dedup, token files, toxicity."""
