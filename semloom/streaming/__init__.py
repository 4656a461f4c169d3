"""Extensions beyond batch work: validation of streams."""
