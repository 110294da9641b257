"""Operators: shingles, samples, trees, folds, forests, transforms, detectors, forecasts, clusters."""
