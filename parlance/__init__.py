"""Conversation analytics on Spark: raw transcripts in, structured and queryable relations out."""
