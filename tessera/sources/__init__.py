"""Text formats in and out, and generators."""
