"""Operators over word lists, fonts, backgrounds and pixels."""
