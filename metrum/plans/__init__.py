"""Physical building blocks: skew-safe windows, as-of joins, and tiled folds."""
