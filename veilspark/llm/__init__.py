"""Training-data operators: decontamination, mixing, extraction, de-duplication, filters and counts."""
