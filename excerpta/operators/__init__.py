"""Extractors on bytes: what has no Catalyst form. Each is a function of one value that ``plans.extract`` runs over Arrow batches."""
