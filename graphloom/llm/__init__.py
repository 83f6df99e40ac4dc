"""Training-data preparation: packing, PII, tokenising, deduplication, decontamination,
quality and toxicity scoring, web archives. Nothing else in the library imports this package."""
