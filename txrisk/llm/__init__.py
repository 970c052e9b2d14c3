"""Operators for preparing large training corpora; nothing else imports them."""
