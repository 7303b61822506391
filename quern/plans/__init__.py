"""Registered queries and plan inspection."""
