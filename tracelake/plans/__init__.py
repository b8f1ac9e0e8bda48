"""Named query plans over the driver tables."""
