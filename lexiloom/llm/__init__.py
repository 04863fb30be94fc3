"""Training-data operators: dedup, packing, scoring, filtering and scanning of document tables."""
