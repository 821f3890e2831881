"""DataFrame operators: rendering, tokens, batches, metrics, losses, generation."""
