"""Operators that prepare text, secrets, media and chats for model training."""
