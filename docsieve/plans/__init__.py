"""Jobs composed from operators: preprocessing, experiments, final model."""
