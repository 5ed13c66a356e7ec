"""Relational operators over ordered corpora, dialogues, questions and chunk boundaries."""
