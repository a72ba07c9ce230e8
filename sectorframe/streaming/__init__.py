"""Running sums over streams of cells."""
