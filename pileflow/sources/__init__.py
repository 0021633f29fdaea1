"""Part of pileflow."""
