"""Models, their validation and ensembles."""
