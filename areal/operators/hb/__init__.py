"""Hierarchical Bayes models: latent Gaussian fields whose hyperparameters are integrated over a grid (nested Laplace approximation)."""
