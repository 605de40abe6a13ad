"""Dataset preparation, pooling, estimators and ranking."""
