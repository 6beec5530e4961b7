"""Where recordings come from and where transcripts go."""
