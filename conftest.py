"""Makes the repository's modules importable in tests."""
