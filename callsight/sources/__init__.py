"""Reading and writing: the raw topic, dead letters, the log table, the chat tables."""
