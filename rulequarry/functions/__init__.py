"""Column builders: measures, scores, certainties, normalizers, probabilities."""
