"""Program cleaners, merges, gap reports and panels."""
