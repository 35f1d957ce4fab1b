"""Sources: transcript files, sidecars, rates."""
