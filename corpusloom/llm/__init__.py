"""Training-data operators: filters, de-duplication, packing, tokenizing and search."""
