"""The engine's operators: transcripts to events, events to claims and contracts, claims to verdicts."""
