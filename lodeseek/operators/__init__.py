"""DataFrame operators: top-k, pooling, numbering, merging, statistics."""
