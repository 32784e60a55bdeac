"""The stateless stages on Structured Streaming sources."""
