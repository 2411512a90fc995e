"""Scalar building blocks: JSON access, identifiers, instants, hashes."""
