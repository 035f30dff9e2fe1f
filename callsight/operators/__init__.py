"""DataFrame operators over events, logs, conversations and call records."""
