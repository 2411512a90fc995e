"""The sequence and graph model in numpy, its training and validation."""
