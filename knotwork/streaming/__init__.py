"""Edge streams: incremental counts and edge uniqueness with watermarks."""
