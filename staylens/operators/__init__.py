"""DataFrame operators: cleaning, features, splits, models, metrics, exploration."""
