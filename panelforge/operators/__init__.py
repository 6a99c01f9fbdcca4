"""Panel operators: time windows, cross-sections, labels, benchmarks, scaling,
feature selection, training and evaluation."""
