"""Training-data operators: dedup, filtering, scoring, mixing and packing of documents."""
