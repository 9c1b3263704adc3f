"""Rules over directories that files keep arriving in."""
