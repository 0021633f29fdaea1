"""Column functions: flags, CIGAR strings and C-style number formats."""
