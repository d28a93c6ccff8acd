"""From names and texts to strategies and experiments."""
