"""Operators for preparing language-model training data (stands alone: nothing else imports it)."""
