"""DataFrame -> DataFrame operators: ranking, windows, side comparisons, reshape, statistics."""
