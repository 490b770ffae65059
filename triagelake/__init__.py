"""Conversation-triage analytics expressed as Spark DataFrame jobs."""
