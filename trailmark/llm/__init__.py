"""Training-data operators: ten corpus operators and the helpers they share."""
