"""Training-data operators: scoring, filtering, deduplication, mixing and tokenising of documents."""
