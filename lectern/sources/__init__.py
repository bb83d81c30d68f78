"""Readers, writers and model seams."""
