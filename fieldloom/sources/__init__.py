"""Readers and writers of sample, landmark, metric, spec, split and latent tables."""
