"""Column functions: missing values, array spectra, scores."""
