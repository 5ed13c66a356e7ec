"""Column functions: text, byte tokens, dialogue messages, answers and schedules."""
