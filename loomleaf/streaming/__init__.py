"""Extensions for arriving files."""
