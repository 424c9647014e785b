"""Text-defined sparse retrieval and its study, as ordinary DataFrame transformations."""
