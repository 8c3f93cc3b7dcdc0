"""Training-data operators on document, page, conversation and embedding tables."""
