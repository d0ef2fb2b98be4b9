"""Where transcripts and model responses come from."""
