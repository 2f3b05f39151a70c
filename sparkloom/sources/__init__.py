"""File inventory, journal scans, content-addressed blobs, and versioned tables."""
