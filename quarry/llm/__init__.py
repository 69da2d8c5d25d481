"""Training-data operators: deduplication, decontamination, scans, tokenisation, archives."""
