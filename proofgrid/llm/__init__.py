"""Training-data operators: ten jobs over documents, pages, benchmark, labels and conversations."""
