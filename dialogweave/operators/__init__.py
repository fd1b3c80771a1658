"""DataFrame operators over transcripts, logs, slots, topics and documents."""
