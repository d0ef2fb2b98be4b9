"""Operators on relations of transcripts, chunks, segments and items."""
