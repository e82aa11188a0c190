"""DataFrame-to-DataFrame steps of the feature chain."""
