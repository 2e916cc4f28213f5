"""End-to-end jobs: evaluation, data preparation, batch inference."""
