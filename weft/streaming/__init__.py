"""Running edge and node counts over a stream of triplets."""
