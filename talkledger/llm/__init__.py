"""Training-data operators: archives, search, privacy, extraction, deduplication,
quality, tokenisation, licences, decontamination and sharding."""
