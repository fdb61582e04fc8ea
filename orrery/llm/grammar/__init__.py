"""Recognisers: each raises Broken unless a text is well-formed in its language."""
