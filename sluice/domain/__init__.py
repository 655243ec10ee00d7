"""Security vocabularies and threat indicators."""
