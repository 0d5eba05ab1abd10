"""The stateless operators on streaming input."""
