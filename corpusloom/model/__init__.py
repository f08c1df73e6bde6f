"""A small language model of the kind the corpora are made for: enough to train, check and sample at toy sizes."""
