"""DataFrame operators: histories, features, sequences, training sets, metrics."""
