"""Sources: stacks, tiles, directories, configuration, weights, and the adapter from business tables."""
