"""Full-text index and ranked search over tables."""
