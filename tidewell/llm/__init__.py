"""Training-data operators: dedup, filtering, formatting, packing and mixing at corpus scale."""
