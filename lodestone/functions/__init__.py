"""Column functions: text, similarity, manifests."""
